"""Personal information inside free text.

Protected entities - mailboxes, telephone numbers, identity numbers and street addresses - are recognised by form and label: they are what the corpus
statistics start from.  Person names follow no list: every run of capitalised words is a candidate, and the corpus decides by how much a term
discloses.  The disclosure of a term is its pointwise mutual information with standing beside a protected entity - how much more often its candidates
do so than candidates do at large - as a share of the most that is possible, so that it means the same in every corpus.  Words and phrases whose disclosure and support pass the thresholds make their candidates names; those
stay text otherwise.  Runs with words that the corpus writes in lower case as often as capitalised are ordinary words.  In scripts without capitals or
spaces a short run of ideographs right before a protected entity is a candidate, and it must keep to few such entities: a label stands before ever new
ones.

Mentions have places (code points) in their texts, and ``redact`` replaces by place.  Null and empty texts give no rows; a mention that occurs several
times in a document is one row of ``personal_information``.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, stored, table

_AT = r"(?:\s?[\(\[\{<]\s?(?:at|@)\s?[\)\]\}>]\s?|\s(?:at|AT)\s)"
_DOT = r"(?:\s?[\(\[\{]\s?(?:dot|\.)\s?[\)\]\}]\s?|\s(?:dot|DOT)\s|\.)"
_LOCAL = r"[^\W_](?:[\w.+'-]{0,62}\w)?"
EMAIL = re.compile(rf"(?<![\w.+@/-])(?:(?P<plain>{_LOCAL}@(?:[^\W_][\w-]{{0,62}}\.){{1,8}}[^\W\d_]{{2,63}})|(?P<odd>{_LOCAL}{_AT}(?:[^\W_][\w-]{{0,62}}{_DOT}){{1,8}}[^\W\d_]{{2,63}}))(?![\w@])", re.I)
PHONE = re.compile(r"(?<![\w+./:-])(?:\+\d{1,3}[ .-]?(?:\(0\)\s?)?(?:\(?\d{1,5}\)?[ ./-]?){1,6}\d{2,}|\d{3}([.-])\d{3}\1\d{4}|\(0?\d{2,5}\)\s?\d{2,5}(?:[ ./-]?\d{2,5}){1,3}|0\d{1,4}[ /-]\d{2,8}(?:[ -]\d{2,5}){0,4})(?![\w-]|[.:]\d)")
_ID_LABEL = (
    r"(?:passport|passeport|pasaporte|paszport\w*|reisepass\w*|pesel|dni|nif|nie|cpf|rg|curp|insee|siren|tax(?:payer)?(?: id| number| no\.?)?|steuer-?\s?(?:id|nummer|nr\.?)\w*|(?:national|personal|citizen) id(?:entity)?|id(?:entity)? card|"
    r"identity(?: document| card)?|travel document|reisedokument|documento? de (?:voyage|viaje|identidad|identidade)|carte d['’]identité|dowód(?: osobisty)?|driv(?:er['’]s|ing) licen[cs]e|personalausweis\w*|ausweis\w*|ssn|social security|national insurance|ni|nino|sozialversicherung\w*|versicherungsnummer|svnr|social insurance|sin|codice fiscale|bsn|паспорт\w*|инн|снилс)"
)
_ID_VALUE = r"(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{3}-\d{2}-\d{4}|\d{2} \d{3} \d{3} \d{3}|[A-Z]{1,3}[ -]?\d{5,9}[A-Z]?|[XYZ]?-?\d{7,8}-?[A-Z]|\d{2,4}(?:[ .-]\d{2,4}){2,4}|\d{8,14})"
ID_LABELLED = re.compile(rf"(?<!\w)(?:(?i:{_ID_LABEL})(?:[ -](?i:no\.?|nr\.?|number|num\.?|id|card))?|(?i:number|no\.|nummer|número|numéro))\s?[:#=]?\s?(?:is |lautet |est |es )?(?P<v>{_ID_VALUE})(?![\w-]|\.\d)")
ID_SHAPE = re.compile(r"(?<![\w.-])(?:(?!000|666)\d{3}-\d{2}-\d{4}|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TQW-Z] ?\d{2} \d{2} \d{2} ?[A-D]|QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![\w-]|\.\d)")
_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĪĮŁŃŇŌŐŒŘŚŠŞŤŪŮŰŹŻŽΑ-ΩЁЄІЇА-Я"
_CAPW = rf"[{_UP}][^\W\d_]+(?:[-’'][{_UP}]?[^\W\d_]+)*"
_NUM = r"\d{1,5}(?:[a-zA-Z](?!\w))?"
_EN = r"(?:Street|Road|Avenue|Lane|Close|Court|Drive|Crescent|Terrace|Place|Square|Way|Hill|Gardens?|Grove|Mews|Boulevard|Parkway|Row|Walk|Rd\.?|St\.|St|Ave\.?|Ln\.?|Dr\.|Blvd\.?)"
_FLAT = r"(?:,? (?:flat|apt\.?|apartment|unit|suite|appt\.?|piso|puerta|m\.|lok\.|Wohnung|Whg\.?|кв\.) ?\w{1,5})?"
ADDRESS = re.compile(
    rf"(?<![\w/.-])(?:(?:(?:Flat|Apt\.?|Unit) \w{{1,4}}, )?{_NUM},? (?:{_CAPW} ){{1,3}}{_EN}(?![\w]){_FLAT}"
    rf"|{_NUM}(?: bis| ter)?,? (?:rue|avenue|av\.|boulevard|bd|place|chemin|allée|impasse|quai|route|cours|square|passage)(?: (?:de la|de l['’]|des|du|de|d['’]|le|la|les))?(?: ?{_CAPW}(?:[ -]{_CAPW}){{0,3}}){_FLAT}"
    rf"|(?:[Cc]alle|[Aa]venida|[Aa]vda\.|[Pp]laza|[Pp]aseo|[Cc]amino|[Cc]arrera|[Rr]onda|[Rr]ua|[Tt]ravessa|[Ll]argo|[Pp]raça|[Aa]lameda|[Cc]\/)(?: (?:de la|de los|de las|del|de|da|do|das|dos|el|la))?(?: {_CAPW}){{1,3}},? (?:n[.ºo°]+ ?)?{_NUM}{_FLAT}"
    rf"|(?:ul\.|al\.|pl\.|os\.|ulica|aleja|plac)(?: {_CAPW}){{1,3}} \d{{1,4}}[a-zA-Z]?(?:/\d{{1,4}})?{_FLAT}"
    rf"|(?:ул\.|улица|пр\.|проспект|пер\.)(?: [А-ЯЁ][а-яё]+){{1,3}},? (?:д\. ?)?\d{{1,4}}{_FLAT}"
    rf"|(?:{_CAPW} )?(?:[{_UP}][^\W\d_]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|steig|steg|graben|chaussee|promenade|markt|hof|berg|pfad|twiete|zeile)|(?:Am|An der|An den|Auf der|Im|In der|Zum|Zur|Unter den) {_CAPW}) {_NUM}(?:/\d{{1,4}})?{_FLAT})(?![\w-])"
)
_PARTICLE = r"(?:van der|van den|van|von der|von|de la|de los|de|da|dos|del|della|di|du|der|den|la|le|bin|ibn|al|el|ter|ten|zu)"
NAME = re.compile(rf"(?<![\w@:./#`'’&-])(?<!`)(?P<first>{_CAPW})(?P<rest>(?:[ ](?:{_PARTICLE} )?(?:{_CAPW}|[{_UP}]\.))+)(?![\w@(`/]|\.\w|['’]\w)")
#: Family name first, as in registers: one capitalised word on each side of the comma, and none beyond.
INVERTED = re.compile(rf"(?<![\w@:./#`'’&-])(?P<first>{_CAPW}), {_CAPW}(?: [{_UP}]\.)?(?![\w@(`/-]|\.\w|['’]\w| [{_UP}])")
TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Professor Sir Madam Herr Frau Fräulein Monsieur Madame Mme Mlle Señor Señora Sr Sra Don Doña Senhor Senhora Pan Pani Doktor Dipl Ing Mag".split())
_TITLE = re.compile(rf"^(?:(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? )+")
#: Words that are no part of an identifier, path or mailbox.
_PROSE_WORD = re.compile(r"(?<![\w@/._:-])[^\W\d_]+(?:[-’'][^\W\d_]+)*(?![\w@/_]|[.:-]\w)")
_TECH_HOST = re.compile(r"^(?:node|host|srv|server|worker|db|app|n)\d*(?:\.|$)|\.(?:cluster|local|localdomain|internal|svc)(?:\.|$)|^(?:localhost|nohost)", re.I)

#: Bounds of the decision on names: candidates beside protected entities that a word or phrase needs, its disclosure, and how many words the names that
#: are tried at the end of a long run of capitalised words have.
MIN_SUPPORT, DISCLOSURE, NAME_WORDS = 2, 0.3, 6
#: Names in scripts without spaces: whole runs of so many signs.
_SIGNS = re.compile(r"(?<![㐀-鿿々ぁ-ヿ가-힣])[㐀-鿿々ァ-ヿ가-힣]{2,6}(?![㐀-鿿々ぁ-ヿ가-힣])")
_BESIDE = re.compile(r"[\s:：,，、(（<《【\[]{0,4}")


def _overlaps(spans: list[tuple], a: int, b: int) -> bool:
    """Whether one of disjoint spans, sorted by place, meets [a, b)."""
    i = bisect.bisect_left(spans, (a,))
    return i < len(spans) and spans[i][0] < b or i > 0 and spans[i - 1][1] > a


def formed(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what its form or label tells, in order of place; the earlier kinds first where spans meet."""
    out: list[tuple[int, int, str]] = []

    def put(a: int, b: int, kind: str) -> None:
        if not _overlaps(out, a, b):
            bisect.insort(out, (a, b, kind))

    for m in EMAIL.finditer(text):
        v = m.group()
        if m.group("plain"):
            local, _, host = v.partition("@")
            before = text[max(0, m.start() - 12):m.start()].lower()
            if text[m.end():m.end() + 1] == ":" and re.match(r":[\w~/.]", text[m.end():m.end() + 2]) or _TECH_HOST.search(host) or re.search(r"\bnode[ `\"']+$|://$", before) or local.lower() == "git":
                continue
        elif not re.search(r"dot|\(\.\)|\[\.\]", v, re.I) and not re.search(r"[\(\[\{<]\s?(?:at|@)", v, re.I):
            continue
        put(m.start(), m.end(), "email")
    for m in ID_LABELLED.finditer(text):
        v = m.group("v")
        label = m.group()[: m.start("v") - m.start()].strip(" :#=").lower()
        if label in ("number", "no.", "nummer", "número", "numéro") and not ID_SHAPE.fullmatch(v):
            continue
        if sum(c.isdigit() for c in v) >= 6:
            put(m.start("v"), m.end("v"), "idnum")
    for m in ID_SHAPE.finditer(text):
        put(m.start(), m.end(), "idnum")
    for m in PHONE.finditer(text):
        v = m.group()
        digits = sum(c.isdigit() for c in v)
        if 9 <= digits <= 15 and not re.fullmatch(r"\d{2} \d{3} \d{3} \d{3}", v) and not re.search(r"\d{4}-\d\d-\d\d", v):
            put(m.start(), m.end(), "phone")
    for m in ADDRESS.finditer(text):
        put(m.start(), m.end(), "address")
    return out


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    v = text[a:b]
    t = _TITLE.match(v)
    return (a + t.end(), b) if t else (a, b)


def name_candidates(text: str, spans: list[tuple[int, int, str]]) -> list[tuple]:
    """(start, end, words skipped, phrase before, phrase after, protected entity that follows or None, start of the run) of possible names.

    A run may begin with an ordinary word that opens a sentence, so its ends of two and more words are candidates as well.  A family name, a comma and
    a given name are a candidate as a whole.
    """
    raw = []
    for m in NAME.finditer(text):
        a, b = _trim(text, m.start(), m.end())
        if not _overlaps(spans, a, b) and " " in text[a:b]:
            raw.append((a, b))
    taken = [(a, b, "") for a, b in raw]
    for m in INVERTED.finditer(text):
        a, b = m.span()
        if not _overlaps(spans, a, b) and not _overlaps(taken, a, b) and not re.search(rf"[{_UP}][^\W\d_]*[.,]? $", text[max(0, a - 64):a]):
            raw.append((a, b))
    raw.sort()
    marks = sorted([(a, b, "§") for a, b in raw] + [(a, b, "¤" + k) for a, b, k in spans])
    begins = [a for a, _ in raw]
    out = []
    for a, b in raw:
        right, near = _phrase(_after(text, b, marks), True), _meets(text, b, spans, begins)
        starts = [a + m.start() for m in re.finditer(r"\S+", text[a:b])][:-1]
        for skip, x in list(enumerate(starts))[-(NAME_WORDS - 1):] if "," not in text[a:b] else [(0, a)]:
            if skip and (text[x + 1:x + 2] in (".", "") or not text[x].isupper()):
                continue
            out.append((x, b, skip, _phrase(_before(text, x, marks, a), False), right, near, a))
    for m in _SIGNS.finditer(text):
        a, b = m.span()
        if not _overlaps(spans, a, b):
            i = bisect.bisect_left(spans, (b,))
            x = spans[i] if i < len(spans) else None
            out.append((a, b, -1, "", "", text[x[0]:x[1]] if x and x[2] != "address" and _BESIDE.fullmatch(text, b, x[0]) else None, a))
    return out


def _meets(text: str, b: int, spans, begins) -> str | None:
    """The mailbox or number that follows a candidate in the same sentence or on the next line, with no other candidate before it."""
    i = bisect.bisect_left(begins, b)
    end = begins[i] if i < len(begins) else len(text)
    for x, y, k in spans[bisect.bisect_left(spans, (b,)):]:
        if x > end:
            break
        if k != "address":
            gap = text[b:x]
            if gap.count("\n") <= 1 and not re.search(r"[.!?]\s+[^\W\d_]", gap) and (("\n" not in gap) or not gap.strip(" \n<(,:;") or gap.strip(" \n<(").lower() in ("tel.", "tel", "phone", "e-mail:", "email:")):
                return text[x:y]
            return None
    return None


_PHRASE_TOKEN = re.compile(r"\n|[^\W_]+(?:[-’'][^\W_]+)*|[^\s]")


def _after(text: str, at: int, marks) -> list[str]:
    """The two tokens after a position, other spans as their marks."""
    got: list[str] = []
    i = bisect.bisect_left(marks, (at,))
    while len(got) < 2:
        m = _PHRASE_TOKEN.search(text, at, marks[i][0] if i < len(marks) else len(text))
        if m:
            got.append(m.group())
            at = m.end()
        elif i < len(marks):
            got.append(marks[i][2])
            at = marks[i][1]
            i += 1
        else:
            break
    return got


def _last(text: str, low: int, high: int, want: int) -> list[str]:
    """The last tokens of text[low:high], in order, from a window that grows until none of them can be cut off."""
    width = 64
    while True:
        start = max(low, high - width)
        got = _PHRASE_TOKEN.findall(text, start, high)
        if start == low or len(got) > want:
            return got[-want:]
        width *= 4


def _before(text: str, at: int, marks, own: int) -> list[str]:
    """The two tokens before a position, other spans as their marks; ``own`` is where the candidate's own mark begins."""
    got: list[str] = []
    i = bisect.bisect_left(marks, (at,))
    if i and marks[i - 1][0] == own:
        i -= 1
    while len(got) < 2:
        low = marks[i - 1][1] if i else 0
        got = _last(text, low, at, 2 - len(got)) + got
        if len(got) == 2 or not i:
            break
        got.insert(0, marks[i - 1][2])
        at = marks[i - 1][0]
        i -= 1
    return got


def _phrase(got: list[str], after: bool) -> str:
    """The tokens beside a candidate as one phrase, digits as 9; a line's or sentence's beginning is a phrase of its own."""
    got = ["⏎" if t == "\n" else re.sub(r"\d+", "9", t.lower()) for t in got]
    if not after and got and re.fullmatch(r"[.!?。！？*•>|]", got[-1]):
        return "⏎"  # a sentence or list item begins
    if after and got and got[0] == "⏎" or not after and got and got[-1] == "⏎":
        return " ".join(got) if any("¤" in t or t in ("-", "--") for t in got) else "⏎"
    return " ".join(got) or "⏎"


_FOUND = "what string, doc_id bigint, kind string, value string, start int, stop int, left string, right string, beside string, skip int, run int, low bigint, cap bigint"


def scan(docs: DataFrame) -> DataFrame:
    """What one pass over all documents finds, in the columns of _FOUND.

    what = span: found by form; name: candidate; word: how often a batch writes a word in lower case and capitalised (pre-aggregated).
    """
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            low: Counter = Counter()
            cap: Counter = Counter()
            for doc, text in zip(b["doc_id"], b["text"]):
                if not text:
                    continue
                spans = formed(text)
                rows.extend(("span", doc, k, text[x:y], x, y, None, None, None, None, None, 0, 0) for x, y, k in spans)
                rows.extend(("name", doc, "name", text[x:y], x, y, left, right, near, skip, run, 0, 0) for x, y, skip, left, right, near, run in name_candidates(text, spans))
                bare = "".join(text[y:x] for (_, y, _), (x, _, _) in zip([(0, 0, ""), *spans], [*spans, (len(text), 0, "")]))  # mailboxes write names small
                for w in _PROSE_WORD.findall(bare):
                    (low if w[0].islower() else cap)[w.lower()] += 1
            rows.extend(("word", None, None, w, None, None, None, None, None, None, None, low[w], cap[w]) for w in low.keys() | cap.keys())
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "start": "Int32", "stop": "Int32", "skip": "Int32", "run": "Int32"})

    return spread(docs.select("doc_id", "text").filter(F.length("text") > 0)).mapInPandas(run, _FOUND)


def _words_of(value) -> F.Column:
    return F.filter(F.split(F.regexp_replace(value, r"[.,]", ""), r"[ ]"), lambda x: F.length(x) > 1)


def disclosure(per: DataFrame, base: DataFrame) -> DataFrame:
    """``disclosure`` of terms: pointwise mutual information with protected entities over its greatest value, from ``n`` candidates of which ``s`` stand
    beside one, and the same counts ``all_n`` and ``all_s`` of all candidates, one row.  Where all candidates stand beside one it is 1."""
    j = per.crossJoin(F.broadcast(base))  # base is one row
    most = F.log2(F.col("all_n") / F.col("all_s"))
    return j.withColumn("disclosure", F.when(most > 0, F.log2(F.col("s") * F.col("all_n") / (F.col("n") * F.col("all_s"))) / most).otherwise(1.0))


def decide_names(found: DataFrame) -> DataFrame:
    """(doc_id, value, start, stop, left, right) of the name candidates whose disclosure passes the thresholds."""
    words = found.filter(F.col("what") == "word").groupBy(F.col("value").alias("word")).agg(F.sum("low").alias("low"), F.sum("cap").alias("cap"))
    common = words.filter(F.col("low") >= F.greatest(F.lit(1), F.col("cap") * 0.05)).select("word", F.lit(True).alias("common"))
    cand = found.filter((F.col("what") == "name") & (F.col("skip") >= 0)).select("doc_id", "value", "start", "stop", "left", "right", "skip", "run", F.col("beside").isNotNull().alias("near"))
    cand = cand.withColumn("_id", F.xxhash64("doc_id", "run", "skip"))
    word = F.explode(F.array_distinct(F.transform(_words_of(F.col("value")), F.lower))).alias("word")
    each = cand.select("_id", "near", word).join(common, "word", "left")
    ordinary = each.filter("common").select("_id").distinct().withColumn("ordinary", F.lit(True))
    every = stored(cand.join(ordinary, "_id", "left"), "candidates")
    # what candidates at large do, ordinary words and all
    base = stored(every.agg(F.count("*").alias("all_n"), F.count_if("near").alias("all_s")), "base")
    cand = every.filter("ordinary is null").drop("ordinary")
    each = cand.select("_id", "near", word)
    per_word = disclosure(each.groupBy("word").agg(F.count("*").alias("n"), F.count_if("near").alias("s")).filter(F.col("s") >= MIN_SUPPORT), base)
    personal = per_word.filter(F.col("disclosure") >= DISCLOSURE).select("word")
    known = each.join(personal, "word", "left_semi").select("_id").distinct().withColumn("known", F.lit(True))
    cand = stored(cand.join(known, "_id", "left").withColumn("known", F.coalesce("known", F.lit(False)) | F.col("near")), "known")
    # phrases stand beside names where their candidates, each value once, hold such words
    sides = cand.select("_id", "value", "known", F.explode(F.array(F.concat(F.lit("<"), "left"), F.concat(F.lit(">"), "right"), F.concat(F.lit("<"), "left", F.lit(">"), "right"))).alias("phrase")).filter(F.col("phrase").rlike(r"\p{L}{2,}"))
    values = every.select("value", F.lit(False).alias("known")).unionByName(cand.select("value", "known")).groupBy("value").agg(F.max("known").alias("known"))
    held = stored(values.agg(F.count("*").alias("all_n"), F.count_if("known").alias("all_s")), "base")
    per_phrase = sides.groupBy("phrase", "value").agg(F.max("known").alias("known")).groupBy("phrase").agg(F.count("*").alias("n"), F.count_if("known").alias("s")).filter(F.col("s") >= MIN_SUPPORT)
    strong = disclosure(per_phrase, held).filter(F.col("disclosure") >= DISCLOSURE).select("phrase")
    in_phrase = sides.join(strong, "phrase", "left_semi").select("_id").distinct().withColumn("told", F.lit(True))
    out = cand.join(in_phrase, "_id", "left").filter(F.col("near") | F.col("told"))
    # of the accepted ends of one run the longest is the name as written
    cols = ["value", "start", "stop", "left", "right", "near", "known"]
    best = out.groupBy("doc_id", "run").agg(F.min_by(F.struct(*cols), "skip").alias("b")).select("doc_id", "b.*")
    return best.unionByName(decide_signs(found), allowMissingColumns=True)


def decide_signs(found: DataFrame) -> DataFrame:
    """(doc_id, value, start, stop) of runs of signs that stand beside protected entities at least half of the time, and beside the same ones again."""
    runs = found.filter((F.col("what") == "name") & (F.col("skip") < 0))
    per = runs.groupBy("value", "beside").agg(F.count("*").alias("m")).groupBy("value").agg(F.sum("m").alias("n"), F.sum(F.when(F.col("beside").isNotNull(), F.col("m"))).alias("s"), F.count("beside").alias("entities"))
    names = per.filter((F.col("s") >= MIN_SUPPORT) & (F.col("s") * 2 >= F.col("n")) & (F.col("entities") * 2 <= F.col("s"))).select("value")
    return runs.join(names, "value", "left_semi").select("doc_id", "value", "start", "stop")


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, value, start, stop) of every mention in the documents, by place."""
    found = stored(scan(docs), "found")
    spans = found.filter(F.col("what") == "span").select("doc_id", "kind", "value", "start", "stop")
    names = stored(decide_names(found).select("doc_id", "value").distinct(), "names")
    # a name that is told somewhere in a document is one wherever it stands there
    places = found.filter(F.col("what") == "name").join(names, ["doc_id", "value"], "left_semi").select("doc_id", F.lit("name").alias("kind"), "value", "start", "stop")
    return spans.unionByName(places).distinct()


def personal_information(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, pii_value) of every mention in the documents."""
    return mentions(docs).select("doc_id", "kind", F.col("value").alias("pii_value")).distinct()


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text) with each mention (doc_id, kind, start, stop) replaced by its kind in square brackets; of mentions that meet the longer counts.

    Documents without mentions and null texts stay as they are.
    """
    per = found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop", "kind")).alias("_m"))

    @F.pandas_udf("string")
    def replace(text: pd.Series, places: pd.Series) -> pd.Series:
        def one(t, ms):
            if t is None or ms is None or not len(ms):
                return t
            out, at = [], 0
            for m in sorted(ms, key=lambda m: (m["start"], -m["stop"])):
                if m["start"] >= at:
                    out += [t[at:m["start"]], f"[{m['kind'].upper()}]"]
                    at = m["stop"]
            return "".join([*out, t[at:]])

        return pd.Series([one(t, m) for t, m in zip(text, places)])

    return docs.select("doc_id", "text").join(per, "doc_id", "left").select("doc_id", replace("text", "_m").alias("text"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_information(table(spark, folder, "documents"))


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with typed placeholders."""
    docs = table(spark, folder, "documents")
    return redact(docs, mentions(docs))

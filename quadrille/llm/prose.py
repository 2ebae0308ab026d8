"""Natural language inside code.

Comments, string literals and documentation of a file are cut into passages (paragraphs and sentences).  One Aho-Corasick pass over all passages
of a file finds the function words of all languages, checked at word boundaries; a word that n languages share gives each of them 1/n votes.
Writing systems without word spaces are settled by script: kana means Japanese, other ideographs Chinese.  A passage needs five words, or ten
characters in such scripts.
"""

from __future__ import annotations

import bisect
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .syntax import Parsed, language_of, normal, parse_source
from .common import analyse, current, source_files

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on be by this are from or an at not have has but which they its been were can all one will when if into than then them these some only other after before every each because there their our we you he she how where while until without during between under over so no any does do should would could may must a i just about what who why",
    "de": "der die das und ist nicht mit von zu den dem des ein eine einer einem einen auf für im sich auch als an er sie es wird werden sind war hat bei nach aus wie wenn nur oder aber noch vor bis durch über zum zur ohne alle jeder jede jedes jeden diese dieser dieses diesem kein keine unter beim vom ins während nachdem bevor sobald falls damit dass weil sehr kann muss soll hier dort immer schon wurde wer was",
    "es": "el la los las de y en que un una es por con para no se lo del al como más pero sus su este esta esto estos estas ser son fue ha hay si sin sobre entre cuando hasta desde todo toda todos todas cada también solo sólo después antes durante aunque según mientras otra otro vez muy ya donde porque ni nos le les unos unas",
    "fr": "le la les de des et en un une est que qui dans pour pas sur au aux avec ce cette ces il elle par plus ne se son sa ses ou mais comme tout tous toute toutes sans entre quand si être sont été ont leur leurs avant après pendant chaque seulement puis dès lors malgré jusque selon afin où ici très déjà y du nous vous ils on à",
    "pl": "i w na z do nie się że jest to o po za od przez dla jak ale ten ta te tego tej tych są być był była było oraz lub czy gdy kiedy jeśli bez przed pod nad przy każdy każda każde każdym każdej każdego wszystkie wszystkich tylko także już tak który która które mimo podczas zawsze jego jej ich ma można tam tu ze we całą całej cały aby",
    "pt": "o a os as de e em que um uma é por com para não se no na nos nas do da dos das ao aos à às como mais mas seu sua seus suas este esta isto ser são foi há sem sobre entre quando até desde todo toda todos todas cada também só depois antes durante apenas pelo pela pelos pelas num numa já muito onde porque nem outro outra mesmo se está ou",
    "ru": "и в на не что с по из за к у о от для как это но он она они его её их все всё так же или если без при до после перед под над только каждый каждого каждая каждое который которая которые был была было были быть есть чтобы когда где уже ещё также во со между через про один одна",
}
LANGUAGES = ("de", "es", "fr", "ja", "pl", "pt", "ru", "zh")
MIN_WORDS, MIN_CHARS = 5, 10
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
_KANA = re.compile(r"[ぁ-ゟ゠-ヿㇰ-ㇿ]")
_CYR = re.compile(r"[Ѐ-ӿ]")
_PARA = re.compile(r"\n\s*\n|\n(?=\s*(?:[-*+•]\s|\d+[.)]\s|@\w|#+\s|iex|\.\.\.>|```))|```")
_SENT = re.compile(r"(?<=[.!?;:])\s+|(?<=[。！？；])")


@lru_cache(maxsize=1)
def automaton():
    """Aho-Corasick automaton over all function words; the value of a word holds its languages and its vote."""
    import ahocorasick

    langs: dict[str, set] = {}
    for lang, words in FUNCTION_WORDS.items():
        for w in words.split():
            langs.setdefault(w, set()).add(lang)
    a = ahocorasick.Automaton()
    for w, ls in langs.items():
        a.add_word(w, (len(w), tuple(sorted(ls)), 1 / len(ls)))
    a.make_automaton()
    return a


def passages(p: Parsed, text: str) -> list[str]:
    """Paragraphs of comments (adjacent line comments are one), strings and documentation."""
    spans: list[str] = []
    last_line, buf = -2, []
    for start, c, line in p.comments:
        own = not text[text.rfind("\n", 0, start) + 1:start].strip()
        if c.startswith("/*"):
            body = re.sub(r"(?m)^[ \t]*\*+(?!/)[ \t]?", "", c[2:-2].lstrip("*"))
        else:
            body = c.lstrip("#%/").strip()
        if buf and (not own or line != last_line + 1 or c.startswith("/*")):
            spans.append("\n".join(buf))
            buf = []
        if own and not c.startswith("/*"):
            buf.append(body)
            last_line = line
        else:
            spans.append(body)
    if buf:
        spans.append("\n".join(buf))
    spans.extend(s[1] for s in p.strings if s[1] and not s[3].startswith("sigil_r"))
    out = []
    for s in spans:
        out.extend(x for x in _PARA.split(s) if x and x.strip())
    return out


def languages_of(parts: list[str]) -> list[str | None]:
    """Language of each passage, None where it is too short or undecided."""
    low = [x.lower() for x in parts]
    begins, pos = [], 0
    for x in low:
        begins.append(pos)
        pos += len(x) + 1
    joined = "\n".join(low)
    votes: list[dict[str, float]] = [{} for _ in parts]
    n = len(joined)
    for end, (size, langs, vote) in automaton().iter(joined):
        a, b = end - size + 1, end + 1
        if a and (joined[a - 1].isalnum() or joined[a - 1] == "_") or b < n and (joined[b].isalnum() or joined[b] == "_"):
            continue
        v = votes[bisect.bisect_right(begins, a) - 1]
        for lang in langs:
            v[lang] = v.get(lang, 0) + vote
            if size > 1:
                v["+" + lang] = v.get("+" + lang, 0) + 1
    return [_decide(x, v) for x, v in zip(parts, votes)]


def _decide(text: str, v: dict[str, float]) -> str | None:
    kana, han = len(_KANA.findall(text)), len(_HAN.findall(text))
    if kana + han >= MIN_CHARS:
        return "ja" if kana * 10 >= han else "zh"
    words = _WORD.findall(text)
    if len(words) < MIN_WORDS:
        return None
    cyr = sum(bool(_CYR.match(w)) for w in words)
    if cyr >= MIN_WORDS and cyr * 2 > len(words):
        return "ru"
    ranked = sorted(((x, lang) for lang, x in v.items() if lang[0] != "+"), reverse=True)
    if not ranked:
        return None
    best, lang = ranked[0]
    second = ranked[1][0] if len(ranked) > 1 else 0
    if "+" + lang not in v and 2 * sum(len(w) > 3 for w in words) < len(words):
        return None  # one-letter words alone decide only among words of a natural length
    if lang == "ru" or best <= second * 1.15 or best < 1 or best < 0.06 * len(words):
        return None
    return lang


def decided(paras: list[str]) -> list[tuple[str, str, int]]:
    """(passage, language, characters) of the paragraphs whose language is decided, and of sentences within a paragraph of another language or none.

    Characters of such a sentence do not count for its paragraph, so none is counted twice.
    """
    sentences = [(n, y) for n, x in enumerate(paras) for s in [[y for y in _SENT.split(x) if y and y.strip()]] if len(s) > 1 for y in s]
    got = languages_of(paras + [y for _, y in sentences])
    inner: list[list[tuple]] = [[] for _ in paras]
    for (n, y), lang in zip(sentences, got[len(paras):]):
        if lang and lang != got[n]:
            inner[n].append((y, lang, len(y)))
    out = []
    for x, lang, own in zip(paras, got, inner):
        if lang:
            out.append((x, lang, len(x) - sum(y[2] for y in own)))
        out.extend(own)
    return out


def _paragraphs(path: str | None, content: str | None) -> tuple[list[str], int] | None:
    """Passages of a valid code file and its length in characters; None for other files."""
    lang = language_of(path)
    if lang is None:
        return None
    text = normal(content)
    p = parse_source(lang, text)
    return None if p.fault is not None else (passages(p, text), len(text))


def _summed(found: list[tuple]) -> list[tuple[str, int]]:
    out: dict[str, int] = {}
    for _, lang, n in found:
        out[lang] = out.get(lang, 0) + n
    return sorted(out.items())


def prose_of(path: str | None, content: str | None) -> list[tuple] | None:
    """(language, characters) of the passages of a valid code file, summed per language; null for a file that does not parse."""
    got = _paragraphs(path, content)
    return got and _summed(decided(got[0]))


def shares_of(path: str | None, content: str | None) -> list[tuple] | None:
    """(language, characters, share of the file's characters) of a valid code file."""
    got = _paragraphs(path, content)
    return got and [(lang, n, n / got[1]) for lang, n in _summed(decided(got[0]))]


def passages_of(path: str | None, content: str | None) -> list[tuple] | None:
    """(passage, language, characters, share of the file's characters) of a valid code file."""
    got = _paragraphs(path, content)
    return got and [(x, lang, n, n / got[1]) for x, lang, n in decided(got[0])]


def value_passages(_: str | None, value: str | None) -> list[tuple]:
    """(passage, language, characters) of the text of an attribute."""
    return decided([x for x in _PARA.split(normal(value)) if x and x.strip()])


def file_languages(files: DataFrame) -> DataFrame:
    """(file_id, lang, chars, share) for each natural language in the current state of each valid code file; share is that of the file's decided prose."""
    rows = analyse(files, prose_of, "array<struct<lang string, chars bigint>>")
    x = current(rows, "result").select("file_id", F.explode("result").alias("r"), F.aggregate("result", F.lit(0).cast("bigint"), lambda a, y: a + y["chars"]).alias("total"))
    return x.select("file_id", "r.lang", "r.chars", (F.col("r.chars") / F.col("total")).alias("share"))


def file_shares(files: DataFrame) -> DataFrame:
    """(file_id, lang, chars, share) as file_languages, but share is that of all characters of the file."""
    rows = analyse(files, shares_of, "array<struct<lang string, chars bigint, share double>>")
    return current(rows, "result").select("file_id", F.explode("result").alias("r")).select("file_id", "r.*")


def file_passages(files: DataFrame) -> DataFrame:
    """(file_id, passage, lang, chars, share) of each passage with a decided language."""
    rows = analyse(files, passages_of, "array<struct<passage string, lang string, chars bigint, share double>>")
    return current(rows, "result").select("file_id", F.explode("result").alias("r")).select("file_id", "r.*")


def _current_values(attributes: DataFrame, files: DataFrame) -> DataFrame:
    """(attr_id, of, size, result) of the attributes that were read from the current state of their file; ``of`` is the file."""
    newest = files.groupBy("file_id").agg(F.max("mtime").alias("file_mtime"))
    a = attributes.filter(F.col("attr_value").isNotNull()).join(newest, ["file_id", "file_mtime"], "left_semi")
    a = a.select(F.col("attr_id").alias("file_id"), F.col("file_mtime").alias("mtime"), F.lit("").alias("path"), F.col("attr_value").alias("content"), F.col("file_id").alias("of"), F.length("attr_value").cast("bigint").alias("size"))
    rows = analyse(a, value_passages, "array<struct<passage string, lang string, chars bigint>>", None, "of bigint, size bigint")
    return current(rows, "of", "size", "result").withColumnRenamed("file_id", "attr_id")


def attribute_passages(attributes: DataFrame, files: DataFrame) -> DataFrame:
    """(attr_id, file_id, passage, lang, chars, share) of the current attribute values; share is that of the value."""
    x = _current_values(attributes, files).select("attr_id", F.col("of").alias("file_id"), "size", F.explode("result").alias("r"))
    return x.select("attr_id", "file_id", "r.*", (F.col("r.chars") / F.col("size")).alias("share"))


def attribute_shares(attributes: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, lang, chars, share) of the current attribute values of each file; share is that of all their characters."""
    parts = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("lang"), F.col("size").alias("chars"))), F.transform("result", lambda r: F.struct(r["lang"].alias("lang"), r["chars"].alias("chars"))))
    sums = _current_values(attributes, files).select(F.col("of").alias("file_id"), F.explode(parts).alias("p")).groupBy("file_id", "p.lang").agg(F.sum("p.chars").alias("chars"))
    each = sums.groupBy("file_id").agg(F.max(F.when(F.col("lang").isNull(), F.col("chars"))).alias("total"), F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "chars"))).alias("r"))
    return each.select("file_id", "total", F.explode("r").alias("r")).select("file_id", "r.lang", "r.chars", (F.col("r.chars") / F.col("total")).alias("share"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return file_languages(source_files(spark, folder)).filter(F.col("lang") != "en").select("file_id", "lang")


def p3_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Language shares of each file, English included."""
    return file_shares(source_files(spark, folder))


def p3_passages(spark: SparkSession, folder: str) -> DataFrame:
    """The passages themselves with their language."""
    return file_passages(source_files(spark, folder))


def p3_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of attribute values."""
    return attribute_passages(table(spark, folder, "module_attribute"), source_files(spark, folder))


def p3_attribute_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Language shares of the attribute values of each file."""
    return attribute_shares(table(spark, folder, "module_attribute"), source_files(spark, folder))

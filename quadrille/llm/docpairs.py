"""Functions paired with their documentation.

The syntax tree of each valid file is visited for function nodes; the documentation attached by the language's convention becomes the description.
Descriptions that are hidden, empty, placeholders or that only repeat the function's name, kind and number of parameters are dropped.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .syntax import functions, language_of, normal, parse_source
from .common import analyse, current, source_files

#: Words that say nothing about what a function does: notes that documentation is yet to come, and words for kind, name and parameters.
PLACEHOLDER = frozenset(
    "n todo tbd tba wip fixme xxx hack na none nil null undocumented documentation documented document documents docs doc description describe described missing pending later follow follows following yet no not available to be done added add written write come coming soon here see above name names named placeholder stub empty nothing "
    "doku dokumentation beschreibung folgt folgen fehlt fehlen noch später kommt keine kein ausstehend offen siehe namen ergänzen "
    "à a compléter completer documenter manque manquante manquant plus tard venir faire voir nom aucune pas encore de la "
    "por documentar pendiente falta faltan completar descripción descripcion sin documentación documentacion más tarde ver nombre aún "
    "descrição descricao sem documentação documentacao em nome ainda não preencher "
    "do uzupełnienia brak opisu opis dokumentacji później zobacz nazwa "
    "позже позднее описание описания нет документация документации будет добавить дописать смотри имя".split()
)
KIND_WORDS = frozenset("function functions func fn method macro procedure routine def is this the a an it of with for from by and called call calls takes take has have arity parameter parameters param params argument arguments arg args one two three four five zero in on which that".split())
#: Placeholders of writing systems without word spaces.
UNSPACED = re.compile(r"待补充|待完善|待定|暂无|无|没有|文档|说明|描述|稍后|以后|補充|説明なし|説明|記述|未記入|未定|後で|なし|ドキュメント|追加|予定|。|、|：")
_CODE = re.compile(r"```.*?```|~~~.*?~~~", re.S)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_PART = re.compile(r"[^\W_]+")


def description(doc: str) -> str:
    """Documentation without code blocks, examples, headings and tag lines."""
    lines, example = [], False
    for x in _CODE.sub("\n", doc).split("\n"):
        s = x.strip()
        example = bool(s) and (example or s.startswith(("iex>", "iex(", "...>", ">>>")))  # an example ends at a blank line
        if example or s.startswith(("#", ":param", ":return")) or re.match(r"@(?!todo|TODO)\w+\s", s):
            continue
        lines.append(s)
    return "\n".join(lines).strip()


def parts_of(name: str) -> set[str]:
    parts = [x.lower() for y in _PART.findall(name) for x in _CAMEL.split(y) if x]
    return {*parts, "".join(parts)}


def _same(word: str, name: set[str]) -> bool:
    """A word of the name, also in the plural, third person or gerund."""
    if word in name:
        return True
    return any(word == n + s or n.endswith("e") and word == n[:-1] + s or n.endswith("y") and word == n[:-1] + "ies" for n in name if len(n) > 2 for s in ("s", "es", "ing", "ed"))


def says_nothing(doc: str | None, name: str, arity: int) -> bool:
    """Whether a description is absent, a placeholder, or no more than the function's name, kind and number of parameters."""
    text = description(doc or "")
    rest = UNSPACED.sub("", text)
    words = [w.lower() for y in _PART.findall(rest) for w in ([y] if y.lower() in PLACEHOLDER else _CAMEL.split(y)) if w]
    own = parts_of(name)
    left = [w for w in words if not (w in PLACEHOLDER or w in KIND_WORDS or w.isdigit() or _same(w, own))]
    return not left


def pairs_of(path: str | None, content: str | None) -> list[tuple] | None:
    """(fun_name, arity, description, line, end_line, ranges, code) of the documented functions of a valid file.

    A function is all its clauses in one module; ``ranges`` are (start, end) offsets in the normalised text, one for each run of clauses with no
    other function between, and ``code`` is the text of these ranges.
    """
    lang = language_of(path)
    if lang is None:
        return None
    text = normal(content)
    p = parse_source(lang, text)
    if p.fault is not None:
        return None
    clauses: dict[tuple, list] = {}
    last = None
    for n, f in enumerate(functions(p, text)):
        key = (f.name, f.arity, f.module if lang == "elixir" else n)
        runs = clauses.setdefault(key, [])
        if runs and key == last:
            runs[-1].append(f)
        else:
            runs.append([f])
        last = key
    out = []
    for (name, arity, _), runs in clauses.items():
        doc = next((f.doc for r in runs for f in r if not (f.doc is None or f.hidden or says_nothing(f.doc, name, arity))), None)
        if doc is None:
            continue
        ranges = [(r[0].start, r[-1].end) for r in runs]
        out.append((name, arity, "\n".join(x.strip() for x in doc.strip().split("\n")), runs[0][0].line, runs[-1][-1].end_line, ranges, "\n".join(text[a:b] for a, b in ranges)))
    return out


def names_of(path: str | None, content: str | None) -> list[tuple] | None:
    """Distinct (fun_name, arity) of the documented functions of a valid file."""
    pairs = pairs_of(path, content)
    return pairs if pairs is None else list(dict.fromkeys(x[:2] for x in pairs))


def documented_functions(files: DataFrame) -> DataFrame:
    """(file_id, fun_name, arity, description, line, end_line, ranges, code) of the current state of each valid code file, one row for each function."""
    rows = analyse(files, pairs_of, "array<struct<fun_name string, arity int, description string, line int, end_line int, ranges array<struct<start int, end int>>, code string>>")
    return current(rows, "result").select("file_id", F.explode("result").alias("r")).select("file_id", "r.*")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = analyse(source_files(spark, folder), names_of, "array<struct<fun_name string, arity int>>")
    return current(rows, "result").select("file_id", F.explode("result").alias("r")).select("file_id", "r.*")


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs with their descriptions, source ranges and code."""
    return documented_functions(source_files(spark, folder))

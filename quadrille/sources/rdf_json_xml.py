"""JSON-LD (expanded or with a simple context) and RDF/XML documents to statements of the parser's terms."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

from ..functions import terms as T


class FormatError(ValueError):
    """The document is not of the form."""


def from_json_ld(text: str, doc: str = "") -> list[tuple]:
    """Statements of a JSON-LD document.  The context may hold prefixes, terms and @vocab; remote contexts are not fetched."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise FormatError(str(e)) from e
    out: list[tuple] = []
    state = {"n": 0}
    ctx: dict = {}

    def expand(name: str, vocab: bool = True) -> str:
        c = ctx.get(name)
        if isinstance(c, dict):
            c = c.get("@id", name)
        if isinstance(c, str):
            return expand(c, vocab) if c != name else c
        pre, sep, local = name.partition(":")
        if sep and not local.startswith("//") and isinstance(ctx.get(pre), str):
            return expand(ctx[pre]) + local
        return ctx.get("@vocab", "") + name if vocab and not sep else name

    def subject(v: str):
        return ("bnode", doc + v[2:]) if v.startswith("_:") else ("iri", expand(v, False))

    def fresh():
        state["n"] += 1
        return ("bnode", f"{doc}j{state['n']}")

    def value(v, kind=None):
        if isinstance(v, bool):
            return ("lit", "true" if v else "false", T.XSD + "boolean", "")
        if isinstance(v, (int, float)):
            return ("lit", str(v), T.XSD + ("integer" if isinstance(v, int) else "double"), "")
        if isinstance(v, str):
            return subject(v) if kind == "@id" else ("lit", v, expand(kind) if kind else T.XSD + "string", "")
        if "@value" in v:
            if "@language" in v:
                return ("lit", v["@value"], T.LANG_STRING, v["@language"].lower())
            return value(v["@value"], v.get("@type")) if not isinstance(v["@value"], (bool, int, float)) else value(v["@value"])
        if "@list" in v:
            node = ("iri", T.RDF + "nil")
            for x in reversed(v["@list"]):
                cell = fresh()
                out.append((cell, ("iri", T.RDF + "first"), value(x)))
                out.append((cell, ("iri", T.RDF + "rest"), node))
                node = cell
            return node
        return node_of(v)

    def node_of(o: dict):
        s = subject(o["@id"]) if "@id" in o else fresh()
        for k, vs in o.items():
            if k == "@type":
                for t in vs if isinstance(vs, list) else [vs]:
                    out.append((s, ("iri", T.RDF_TYPE), ("iri", expand(t))))
            elif k == "@graph":
                for x in vs:
                    node_of(x)
            elif not k.startswith("@"):
                kind = ctx[k].get("@type") if isinstance(ctx.get(k), dict) else None
                for x in vs if isinstance(vs, list) else [vs]:
                    if x is not None:
                        out.append((s, ("iri", expand(k)), value(x, kind)))
        return s

    for o in data if isinstance(data, list) else [data]:
        if not isinstance(o, dict):
            raise FormatError("a document holds objects")
        c = o.get("@context", {})
        for part in c if isinstance(c, list) else [c]:
            if isinstance(part, dict):
                ctx.update(part)
        if set(o) - {"@context", "@graph"}:
            node_of({k: v for k, v in o.items() if k != "@context"})
        else:
            for x in o.get("@graph", []):
                node_of(x)
    return out


def from_rdf_xml(text: str, doc: str = "") -> list[tuple]:
    """Statements of an RDF/XML document: node and property elements, literals, collections and nested nodes."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise FormatError(str(e)) from e
    out: list[tuple] = []
    state = {"n": 0}
    R, X = "{" + T.RDF + "}", "{http://www.w3.org/XML/1998/namespace}"
    iri = lambda tag: re.sub(r"^\{(.*)\}", r"\1", tag)

    def fresh():
        state["n"] += 1
        return ("bnode", f"{doc}x{state['n']}")

    def node(e, base: str, lang: str):
        base, lang = e.get(X + "base", base), e.get(X + "lang", lang)
        s = ("iri", base + e.get(R + "about") if ":" not in e.get(R + "about") else e.get(R + "about")) if e.get(R + "about") is not None else ("iri", f"{base}#{e.get(R + 'ID')}") if e.get(R + "ID") else ("bnode", doc + e.get(R + "nodeID")) if e.get(R + "nodeID") else fresh()
        if e.tag != R + "Description":
            out.append((s, ("iri", T.RDF_TYPE), ("iri", iri(e.tag))))
        for k, v in e.attrib.items():
            if not k.startswith((R, X)):
                out.append((s, ("iri", iri(k)), ("lit", v, T.LANG_STRING if lang else T.XSD + "string", lang)))
        for p in e:
            prop(s, p, base, lang)
        return s

    def prop(s, p, base: str, lang: str):
        lang = p.get(X + "lang", lang).lower()
        kind = p.get(R + "parseType")
        name = ("iri", iri(p.tag))
        if p.get(R + "resource") is not None:
            r = p.get(R + "resource")
            out.append((s, name, ("iri", r if ":" in r else base + r)))
        elif p.get(R + "nodeID"):
            out.append((s, name, ("bnode", doc + p.get(R + "nodeID"))))
        elif kind == "Collection":
            cell = ("iri", T.RDF + "nil")
            for x in reversed([node(c, base, lang) for c in p]):
                b = fresh()
                out.append((b, ("iri", T.RDF + "first"), x))
                out.append((b, ("iri", T.RDF + "rest"), cell))
                cell = b
            out.append((s, name, cell))
        elif kind == "Resource":
            b = fresh()
            out.append((s, name, b))
            for q in p:
                prop(b, q, base, lang)
        elif len(p):
            for c in p:
                out.append((s, name, node(c, base, lang)))
        else:
            dt = p.get(R + "datatype")
            out.append((s, name, ("lit", p.text or "", dt or (T.LANG_STRING if lang else T.XSD + "string"), "" if dt else lang)))

    base = root.get(X + "base", "")
    for e in root if root.tag == R + "RDF" else [root]:
        node(e, base, root.get(X + "lang", "").lower())
    return out

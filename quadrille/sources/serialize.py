"""Quads as RDF text: N-Triples as rows of text, and Turtle, TriG, JSON-LD and RDF/XML folded subject by subject."""

from __future__ import annotations

from enum import Enum
import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.naming import BASE, DR, OWL, RDF, RDFS, SH, XSD


class Format(Enum):
    """MIME type and file extension."""

    TURTLE = ("text/turtle", "ttl")
    JSON_LD = ("application/ld+json", "jsonld")
    RDF_XML = ("application/rdf+xml", "rdf")
    N_TRIPLES = ("application/n-triples", "nt")
    TRIG = ("application/trig", "trig")


PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "sh": SH, "xsd": XSD, "dr": DR, "schema": BASE}


class SerializationError(ValueError):
    pass


def _escaped(c: Column) -> Column:
    for raw, text in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(text))
    return c


def _node(value: Column, kind: Column) -> Column:
    return F.when(kind == "bnode", F.concat(F.lit("_:"), value)).otherwise(F.concat(F.lit("<"), value, F.lit(">")))


def _object() -> Column:
    text = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'))
    typed = F.when(F.col("o_datatype") == XSD + "string", text).otherwise(F.concat(text, F.lit("^^<"), F.col("o_datatype"), F.lit(">")))
    return F.when(F.col("o_kind") == "literal", typed).otherwise(_node(F.col("o"), F.col("o_kind")))


def ntriples(quads: DataFrame) -> DataFrame:
    """One line of text per statement, ready for write.text; no order, no collection."""
    return quads.select(F.concat(_node(F.col("s"), F.col("s_kind")), F.lit(" <"), F.col("p"), F.lit("> "), _object(), F.lit(" .")).alias("value"))


def subjects(quads: DataFrame) -> DataFrame:
    """One row per graph and subject in the order of first mention, with its predicates and objects in order."""
    cells = quads.select("graph", "s", "s_kind", "seq", "p", _object().alias("text"), "o", "o_kind", "o_datatype")
    held = F.transform(F.array_sort(F.collect_list(F.struct("seq", "p", "text", "o", "o_kind", "o_datatype"))), lambda x: F.struct(x["p"].alias("p"), x["text"].alias("text"), x["o"].alias("o"), x["o_kind"].alias("o_kind"), x["o_datatype"].alias("o_datatype")))
    return cells.groupBy("graph", "s", "s_kind").agg(F.min("seq").alias("at"), held.alias("cells"))


def _compact(text: Column) -> Column:
    """An IRI in angle brackets as a prefixed name, where a prefix fits and the rest is a plain local name."""
    out = text
    for prefix, space in PREFIXES.items():
        rest = F.substring(text, len(space) + 2, 1 << 30)
        out = F.when(F.startswith(text, F.lit("<" + space)) & rest.rlike(r"^[A-Za-z_][A-Za-z0-9_]*>$"), F.concat(F.lit(prefix + ":"), F.rtrim(rest, F.lit(">")))).otherwise(out)
    return out


def _turtle_object(x: Column) -> Column:
    """An object of Turtle: prefixed names for IRIs and datatypes, bare integers and booleans."""
    bare = F.when((x["o_datatype"] == XSD + "integer") & x["o"].rlike(r"^[+-]?\d+$"), x["o"]).when((x["o_datatype"] == XSD + "boolean") & x["o"].isin("true", "false"), x["o"])
    typed = F.when(x["o_datatype"] == XSD + "string", x["text"]).otherwise(F.concat(F.lit('"'), _escaped(x["o"]), F.lit('"^^'), _compact(F.concat(F.lit("<"), x["o_datatype"], F.lit(">")))))
    return F.when(x["o_kind"] == "literal", F.coalesce(bare, typed)).when(x["o_kind"] == "iri", _compact(x["text"])).otherwise(x["text"])


def turtle_prefixes() -> str:
    return "".join(f"@prefix {k}: <{v}> .\n" for k, v in PREFIXES.items())


def _turtle_lines(quads: DataFrame) -> DataFrame:
    """Each subject with its predicates in order and the Turtle text of their objects."""
    by = subjects(quads)
    names = F.array_distinct(F.transform("cells", lambda x: x["p"]))
    verb = lambda p: F.when(p == RDF + "type", F.lit("a")).otherwise(_compact(F.concat(F.lit("<"), p, F.lit(">"))))
    held = lambda p: F.transform(F.filter("cells", lambda x: x["p"] == p), _turtle_object)
    return by.select("graph", "at", "s", "s_kind", _compact(_node(F.col("s"), F.col("s_kind"))).alias("subject"), F.transform(names, lambda p: F.struct(verb(p).alias("verb"), held(p).alias("objects"))).alias("lines"))


def turtle_blocks(quads: DataFrame) -> DataFrame:
    """The Turtle text of each subject below turtle_prefixes(): predicates joined by semicolons, objects of one predicate by commas.

    Each block stands alone, so blank nodes keep their labels and many graphs are written without a collection.
    """
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["verb"], F.lit(" "), F.array_join(x["objects"], ", "))), " ;\n    ")
    return _turtle_lines(quads).select("graph", "at", "s", F.concat("subject", F.lit(" "), text, F.lit(" .")).alias("block"))


def _pretty(rows: list) -> list[str]:
    """The blocks of one graph; a blank node that is an object once is written where it is used, a list of such in parentheses."""
    nodes = {r["subject"]: r for r in rows if r["s_kind"] == "bnode"}
    uses: dict[str, int] = {}
    for r in rows:
        for x in r["lines"]:
            for o in x["objects"]:
                uses[o] = uses.get(o, 0) + (o in nodes)
    inside = {n for n in nodes if uses.get(n) == 1}
    first, rest = _short(RDF + "first"), _short(RDF + "rest")
    written: set[str] = set()

    def items(label: str) -> list[str] | None:
        """What the list that begins at the node holds; None if the node begins no whole list."""
        out, seen = [], set()
        while label != _short(RDF + "nil"):
            held = {x["verb"]: x["objects"] for x in nodes[label]["lines"]} if label in inside and label not in seen else {}
            if set(held) != {first, rest} or len(held[first]) != 1 or len(held[rest]) != 1:
                return None
            seen.add(label)
            out.append(held[first][0])
            label = held[rest][0]
        written.update(seen)
        return out

    def term(o: str, depth: int) -> str:
        if o not in inside or o in written:
            return o
        listed = items(o)
        if listed is not None:
            return "( " + " ".join(term(x, depth) for x in listed) + " )"
        written.add(o)
        return "[ " + body(nodes[o], depth + 1) + " ]"

    def body(r, depth: int) -> str:
        return f" ;\n{'    ' * depth}".join(f"{x['verb']} {', '.join(term(o, depth) for o in x['objects'])}" for x in r["lines"])

    out = [f"{r['subject']} {body(r, 1)} ." for r in rows if r["subject"] not in inside]
    # blank nodes that only lead to each other
    for label in sorted(inside):
        if label not in written:
            written.add(label)
            out.append(f"{label} {body(nodes[label], 1)} .")
    return out


def _short(iri: str) -> str:
    return next((f"{k}:{iri[len(v) :]}" for k, v in PREFIXES.items() if iri.startswith(v) and iri[len(v) :].isidentifier()), iri)


def _json_ld(rows: list) -> str:
    graphs: dict[str | None, list] = {}
    for r in rows:
        node: dict = {"@id": ("_:" if r["s_kind"] == "bnode" else "") + r["s"]}
        for c in r["cells"]:
            if c["p"] == RDF + "type":
                node.setdefault("@type", []).append(_short(c["o"]))
                continue
            kind = (c["o_datatype"] or "").removeprefix(XSD)
            value: object = {"@id": ("_:" if c["o_kind"] == "bnode" else "") + c["o"]}
            if c["o_kind"] == "literal":
                native = {"string": str, "boolean": lambda x: x == "true", "integer": int, "double": float}.get(kind)
                value = native(c["o"]) if native else {"@type": "xsd:" + kind, "@value": c["o"]}
            node.setdefault(_short(c["p"]), []).append(value)
        graphs.setdefault(r["graph"], []).append({k: v[0] if isinstance(v, list) and len(v) == 1 else v for k, v in node.items()})
    named = [{"@id": g, "@graph": nodes} for g, nodes in graphs.items() if g is not None]
    return json.dumps({"@context": PREFIXES, "@graph": graphs.get(None, []) + named if None in graphs or len(named) != 1 else named[0]["@graph"]}, indent=2, ensure_ascii=False)


def _rdf_xml(rows: list) -> str:
    spaces: dict[str, str] = {v: k for k, v in PREFIXES.items()}

    def name(iri: str) -> str:
        at = max(iri.rfind("#"), iri.rfind("/")) + 1
        if not iri[at:] or not (iri[at].isalpha() or iri[at] == "_"):
            raise SerializationError(f"{iri} is no XML name")
        return f"{spaces.setdefault(iri[:at], f'ns{len(spaces)}')}:{iri[at:]}"

    body = []
    for r in rows:
        about = f"rdf:nodeID={quoteattr(r['s'])}" if r["s_kind"] == "bnode" else f"rdf:about={quoteattr(r['s'])}"
        body.append(f"<rdf:Description {about}>")
        for c in r["cells"]:
            tag = name(c["p"])
            if c["o_kind"] == "literal":
                kind = "" if c["o_datatype"] == XSD + "string" else f" rdf:datatype={quoteattr(c['o_datatype'])}"
                body.append(f"  <{tag}{kind}>{escape(c['o'])}</{tag}>")
            else:
                body.append(f"  <{tag} rdf:{'nodeID' if c['o_kind'] == 'bnode' else 'resource'}={quoteattr(c['o'])}/>")
        body.append("</rdf:Description>")
    return "<rdf:RDF " + " ".join(f"xmlns:{k}={quoteattr(v)}" for v, k in spaces.items()) + ">\n" + "\n".join(body) + "\n</rdf:RDF>\n"


def serialize(quads: DataFrame, form: Format) -> str:
    """The text of a few graphs, assembled on the driver: meant for a schema's graphs, not for data.

    Write ntriples() or turtle_blocks() as text files where the graphs are many.
    """
    if form is Format.N_TRIPLES:
        return "".join(r[0] + "\n" for r in ntriples(quads.orderBy(F.col("graph").asc_nulls_first(), "seq")).collect())
    if form in (Format.TURTLE, Format.TRIG):
        graphs: dict[str | None, list] = {}
        for r in _turtle_lines(quads).orderBy(F.col("graph").asc_nulls_first(), "at").collect():
            graphs.setdefault(r["graph"], []).append(r)
        if form is Format.TURTLE:
            return turtle_prefixes() + "\n" + "\n\n".join(b for rows in graphs.values() for b in _pretty(rows)) + "\n"
        named = [(f"<{g}> " if g is not None else "") + "{\n" + "\n\n".join("  " + b.replace("\n", "\n  ") for b in _pretty(rows)) + "\n}" for g, rows in graphs.items()]
        return turtle_prefixes() + "\n" + "\n\n".join(named) + "\n"
    rows = subjects(quads).orderBy(F.col("graph").asc_nulls_first(), "at").collect()
    return _json_ld(rows) if form is Format.JSON_LD else _rdf_xml(rows)


def read_ntriples(lines: DataFrame) -> DataFrame:
    """Quads (of the default graph) from lines of N-Triples, as a plan of column expressions."""
    v = F.col("value")
    obj = F.regexp_extract(v, r'^\S+ <[^>]*> (.*) \.$', 1)
    quoted = obj.startswith('"')
    text = F.regexp_extract(obj, r'^"((?:[^"\\]|\\.)*)"', 1)
    # one pass over the escapes: a backslash is set aside first, so that it cannot start another
    plain = F.replace(text, F.lit("\\\\"), F.lit("\u0000"))
    for raw, t in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(t), F.lit(raw))
    plain = F.replace(plain, F.lit("\u0000"), F.lit("\\"))
    datatype = F.regexp_extract(obj, r'\^\^<([^>]*)>$', 1)
    term = lambda x: F.when(x.startswith("_:"), F.substring(x, 3, 1 << 30)).otherwise(F.regexp_extract(x, r"^<(.*)>$", 1))
    kind = lambda x: F.when(x.startswith("_:"), "bnode").otherwise("iri")
    s = F.regexp_extract(v, r"^(\S+)", 1)
    return lines.where(F.trim(v) != "").select(
        F.lit(None).cast("string").alias("graph"), term(s).alias("s"), kind(s).alias("s_kind"), F.regexp_extract(v, r"^\S+ <([^>]*)>", 1).alias("p"),
        F.when(quoted, plain).otherwise(term(obj)).alias("o"), F.when(quoted, "literal").otherwise(kind(obj)).alias("o_kind"),
        F.when(quoted, F.when(datatype == "", XSD + "string").otherwise(datatype)).alias("o_datatype"),
    )

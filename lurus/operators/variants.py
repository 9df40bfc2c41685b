"""Flat tables of nested records whose shape varies from tool to tool.

A bottom-up tree automaton gives every JSON node a state, from its own kind and its children's states alone, each node once:

    scalar -> null | text | number | bool          string that holds a JSON list or object -> the state of what it holds
    object -> record     if it has a key of RECORD_KEYS
            | sentence   if it has a key of SENTENCE_KEYS
            | error      if it has a key of ERROR_KEYS
            | envelope of X, or other
    list   -> list of X, or list

X being the highest of record, sentence and error that a child is or leads to. The states route each node: lists, envelopes and encoded strings that lead
to a record are opened wherever they stand, and so are those that lead to a sentence in a record's `sentences` and to an error in a sentence's `errors`,
each of which may be a list, a list of lists, a single object, an encoded string, null or absent. All records, sentences and errors have common
supertype tables with their keys and parent links; `shape` names the structural variant, and `subtypes` has a typed table for each.

A shape is made of a few fixed words (how a node was wrapped, which optional fields it has), never of the data's own keys, so there are no more than some
hundred variants, whatever the input.

Defined results: a payload that is null or no valid JSON (NaN, a second value, nesting beyond Python's stack) gives no rows; null entries of lists count
for positions and give no rows; entries of other kinds (a number among the errors, an error among the sentences) count likewise; the entries of lists
within lists, and all that one envelope leads to, are numbered on; objects of no known key are taken for what is expected in their place; of a key that
occurs twice the last holds; several records in one payload are numbered by record_pos; numbers and booleans in place of texts are read as their JSON
text; rows with a null key are kept; further columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurus.plans.session import importable

RECORD_KEYS = {"sentences", "filename", "primary_category"}
SENTENCE_KEYS = {"errors", "sentence_id", "teks_ocr", "kalimat_koreksi"}
ERROR_KEYS = {"token_salah", "token_benar"}

NODES = (
    "level string, ann_id long, record_pos long, sentence_pos long, error_pos long, shape string, filename string, primary_category string, annotator string, "
    "sentence_id string, category string, teks_ocr string, kalimat_koreksi string, bbox_normalized array<double>, note string, token_salah string, token_benar string"
)
ARROW = pa.schema(
    [(n, pa.list_(pa.float64()) if n == "bbox_normalized" else pa.int64() if n.endswith("_pos") or n == "ann_id" else pa.string()) for n in (c.strip().split()[0] for c in NODES.split(","))]
)
LEVELS = {
    "record": ["filename", "primary_category", "annotator"],
    "sentence": ["sentence_pos", "sentence_id", "category", "teks_ocr", "kalimat_koreksi", "bbox_normalized", "note"],
    "error": ["sentence_pos", "error_pos", "token_salah", "token_benar", "category"],
}


def _refuse(constant: str) -> None:
    raise ValueError(constant)


def parse(text: str | None):
    """A JSON value, or None if the text is not valid JSON."""
    try:
        return json.loads(text, parse_constant=_refuse, parse_int=_number)
    except (ValueError, TypeError, RecursionError):
        return None


class _number(str):
    """An integer as written, of any length."""


def opened(value):
    """(value, whether it was encoded): the list or object that a string holds, else the value itself."""
    if isinstance(value, str) and not isinstance(value, _number) and value.lstrip()[:1] in ("[", "{"):
        inner = parse(value)
        if inner is not None:
            return inner, True
    return value, False


KINDS = ("", "error", "sentence", "record")


class Node:
    """A list or object with its state: own is what it is itself, leads the highest kind that it is or leads to (places in KINDS)."""

    __slots__ = ("items", "listed", "own", "leads", "source")

    def __init__(self, items, source: str | None) -> None:
        self.items, self.listed, self.source = items, isinstance(items, list), source
        self.own = 0
        if not self.listed:
            keys = items.keys()
            self.own = 3 if keys & RECORD_KEYS else 2 if keys & SENTENCE_KEYS else 1 if keys & ERROR_KEYS else 0
        self.leads = self.own or max((x.leads for x in (items if self.listed else items.values()) if isinstance(x, Node)), default=0)

    @property
    def state(self) -> str:
        if self.own:
            return KINDS[self.own]
        kind = "list" if self.listed else "envelope"
        return f"{kind} of {KINDS[self.leads]}" if self.leads else "list" if self.listed else "other"


def annotated(value):
    """A JSON value with a Node for each list and object in it, also for those that strings hold."""
    value, encoded = opened(value)[0], value if isinstance(value, str) else None
    if isinstance(value, list):
        return Node([annotated(v) for v in value], encoded)
    if isinstance(value, dict):
        return Node({k: annotated(v) for k, v in value.items()}, encoded)
    return value


def state(value) -> str:
    """The automaton's state of a JSON value."""
    node = annotated(value)
    if isinstance(node, Node):
        return node.state
    return "null" if node is None else "bool" if isinstance(node, bool) else "number" if isinstance(node, (_number, int, float)) else "text"


def plain(value):
    """The JSON value again; strings that hold JSON as they were."""
    if not isinstance(value, Node):
        return value
    return value.source if value.source is not None else [plain(v) for v in value.items] if value.listed else {k: plain(v) for k, v in value.items.items()}


def _text(value) -> str | None:
    value = plain(value)
    if value is None or isinstance(value, str):
        return None if value is None else str(value)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _routed(value, kind: int, ways: frozenset[str] = frozenset()) -> Iterator[tuple[Node | None, frozenset[str]]]:
    """All nodes of a kind that a value is or leads to, in order, and the ways by which they were wrapped. Entries of lists that are nothing of the kind
    give None, as they count for positions."""
    if not isinstance(value, Node):
        return
    if value.source is not None:
        ways |= {"encoded"}
    if value.own == kind or not value.listed and not value.own and not value.leads:
        yield value, ways
    elif value.listed:
        for v in value.items:
            if isinstance(v, Node) and (v.listed or v.leads >= kind or not v.leads):
                yield from _routed(v, kind, ways | {"list"})
            else:
                yield None, ways | {"list"}
    elif not value.own and value.leads >= kind:
        for v in value.items.values():
            if isinstance(v, Node) and v.leads >= kind:
                yield from _routed(v, kind, ways | {"envelope"})
    elif value.own > kind:  # a record among the sentences
        yield value, ways
    else:
        yield None, ways


def _form(holder: Node, key: str) -> str:
    """The name of the form in which a node has its children."""
    if key not in holder.items:
        return "absent"
    value = holder.items[key]
    if not isinstance(value, Node):
        return "null" if value is None else "scalar"
    lists = value.listed and any(isinstance(v, Node) and v.listed for v in value.items)
    form = "lists" if lists else "list" if value.listed else "wrapped" if not value.own and value.leads else "single"
    return ("encoded-" if value.source is not None else "") + form


def _box(value) -> list[float] | None:
    value = plain(value)
    try:
        return [None if x is None else float(x) for x in value] if isinstance(value, list) else None
    except (TypeError, ValueError):
        return None


def nodes(ann_id: int | None, payload: str | None) -> list[dict]:
    """A row for each record, sentence and error of a payload."""
    try:
        return list(_nodes(ann_id, payload))
    except RecursionError:
        return []


def _nodes(ann_id: int | None, payload: str | None) -> Iterator[dict]:
    root = annotated(parse(payload))
    if not isinstance(root, Node) or root.leads < 3:
        return
    records = ((node, ways) for node, ways in _routed(root, 3) if node is not None and node.own == 3)
    for r, (node, ways) in enumerate(records):
        record, own = node.items, {"ann_id": ann_id, "record_pos": r}
        shape = ("+".join(w for w in ("envelope", "list", "encoded") if w in ways) or "bare") + ":" + _form(node, "sentences")
        yield own | {"level": "record", "shape": shape, "filename": _text(record.get("filename")), "primary_category": _text(record.get("primary_category")), "annotator": _text(record.get("anotator", record.get("annotator")))}
        for i, (node, _) in enumerate(_routed(record.get("sentences"), 2)):
            if node is None:
                continue
            sentence = node.items
            box, note = _box(sentence.get("bbox_normalized")), sentence.get("catatan")
            shape = _form(node, "errors") + ("+box" if box is not None else "") + ("+note" if note is not None else "")
            yield own | {"level": "sentence", "sentence_pos": i, "shape": shape, "bbox_normalized": box, "note": _text(note)} | {k: _text(sentence.get(k)) for k in ("sentence_id", "category", "teks_ocr", "kalimat_koreksi")}
            for j, (node, _) in enumerate(_routed(sentence.get("errors"), 1)):
                if node is not None:
                    error = node.items
                    shape = "+".join(k for k in ("token_salah", "token_benar", "category") if k in error) or "empty"
                    yield own | {"level": "error", "sentence_pos": i, "error_pos": j, "shape": shape} | {k: _text(error.get(k)) for k in ("token_salah", "token_benar", "category")}


def node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = [n for a, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for n in nodes(a, p)]
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


def raw_nodes(df: DataFrame, key: str = "ann_id", payload: str = "payload") -> DataFrame:
    importable(df.sparkSession)
    return df.select(F.col(key).cast("long"), F.col(payload).cast("string")).mapInArrow(node_batches, NODES)


def typed_nodes(df: DataFrame, key: str = "ann_id") -> DataFrame:
    """The same rows of a table whose records already have one nested type; nothing but explodes, which stay in the JVM."""
    base = df.select(F.col(key).cast("long").alias("ann_id"), F.lit(0).cast("long").alias("record_pos"), "filename", "primary_category", "annotator", "sentences")
    form = lambda c: F.when(F.col(c).isNull(), "null").otherwise("list")
    records = base.select(F.lit("record").alias("level"), "ann_id", "record_pos", F.concat(F.lit("typed:"), form("sentences")).alias("shape"), *LEVELS["record"])
    sent = base.select("ann_id", "record_pos", F.posexplode("sentences").alias("sentence_pos", "s")).where("s is not null").withColumn("sentence_pos", F.col("sentence_pos").cast("long"))
    flat = sent.select("ann_id", "record_pos", "sentence_pos", "s.*")
    shape = F.concat(form("errors"), F.when(F.col("bbox_normalized").isNotNull(), "+box").otherwise(""))
    sentences = flat.select(F.lit("sentence").alias("level"), "ann_id", "record_pos", "sentence_pos", shape.alias("shape"), "sentence_id", "category", "teks_ocr", "kalimat_koreksi", "bbox_normalized")
    errors = flat.select("ann_id", "record_pos", "sentence_pos", F.posexplode("errors").alias("error_pos", "e")).where("e is not null")
    errors = errors.select(F.lit("error").alias("level"), "ann_id", "record_pos", "sentence_pos", F.col("error_pos").cast("long").alias("error_pos"), F.lit("typed").alias("shape"), "e.token_salah", "e.token_benar", "e.category")
    return records.unionByName(sentences, allowMissingColumns=True).unionByName(errors, allowMissingColumns=True)


def level(nodes_: DataFrame, name: str) -> DataFrame:
    """The supertype table of one level: each node once, however often its record is stored."""
    return nodes_.where(F.col("level") == name).select("ann_id", "record_pos", "shape", *LEVELS[name]).distinct()


def columns_of(name: str, shape: str) -> list[str]:
    """The columns that a structural variant has, besides its keys."""
    gone: set[str] = set()
    if name == "sentence":
        gone = ({"bbox_normalized"} if "+box" not in shape else set()) | ({"note"} if "+note" not in shape else set())
    elif name == "error" and shape != "typed":
        gone = {"token_salah", "token_benar", "category"} - set(shape.split("+"))
    return [c for c in LEVELS[name] if c not in gone]


def subtypes(nodes_: DataFrame, name: str) -> dict[str, DataFrame]:
    """A typed table for each structural variant of a level, with only the columns that variant has. Shapes are made of fixed words, which bounds them."""
    shapes = [r.shape for r in nodes_.where(F.col("level") == name).select("shape").distinct().orderBy("shape").collect()]
    return {s: level(nodes_, name).where(F.col("shape") == s).select("ann_id", "record_pos", *columns_of(name, s)) for s in shapes}


def write_subtypes(nodes_: DataFrame, path: str) -> None:
    """Writes every typed table in one pass, a folder for each level and variant, whence `read_subtype` reads them."""
    columns = list(dict.fromkeys(c for cs in LEVELS.values() for c in cs))
    nodes_.select("level", "shape", "ann_id", "record_pos", *columns).distinct().write.partitionBy("level", "shape").parquet(path)


def read_subtype(spark: SparkSession, path: str, name: str, shape: str) -> DataFrame:
    """One typed table: only its folder and its own columns are read."""
    return spark.read.parquet(path).where((F.col("level") == name) & (F.col("shape") == shape)).select("ann_id", "record_pos", *columns_of(name, shape))


def worded(text: Column) -> Column:
    """Neither null nor blank, white space of any kind being blank."""
    return F.coalesce(text.rlike(r"[^\s\p{Z}\x{85}\x{1C}-\x{1F}]"), F.lit(False))


def found_errors(typed: DataFrame, raw: DataFrame) -> DataFrame:
    """(ann_id, sentence_pos, error_pos) of every error, in either table, with a token that is neither missing, null nor blank."""
    both = typed_nodes(typed).where("level = 'error'").unionByName(raw_nodes(raw).where("level = 'error'"), allowMissingColumns=True)
    return both.where(worded(F.col("token_salah")) | worded(F.col("token_benar"))).select("ann_id", "sentence_pos", "error_pos").distinct()

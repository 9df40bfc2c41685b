"""Problem 7: token ids of texts by a byte-level BPE, folded in the JVM.

A text is cut into words by the tokenizer's pattern. A word's bytes, each a character of Latin-1, are folded by higher-order functions, one ranked merge a
step: of all neighbours whose joint bytes are a token the pair of lowest rank, the leftmost of equals, is merged, until no pair is a token. The ranks are
one literal: an array of small maps, addressed by the CRC of the piece, so a look-up reads a handful of entries.

Distinct words are counted first, with map-side combine; those that make up HOT_SHARE of all words or more, of which there can be 1 / HOT_SHARE at most,
are folded once and become a second literal. Each text is then encoded where it is read: frequent words are looked up, the rare rest is folded in place,
and no text, word or id is ever shuffled or joined. Words of any length go the same way; a step copies its word's pieces, so the time of a word grows with
the square of its length, by some nanoseconds for each square byte.

Defined results: null and empty texts have the empty list; repeated rows and ids are encoded each by itself; texts of any length are encoded whole;
special tokens' strings are ordinary text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurus.plans.session import checkpointed, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's word pattern; `\s` is spelled out, as Java's knows ASCII only.
SPACE = r"\t-\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}".replace(r"\x{1C}-\x{1F}", "")
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
CELLS = 16384
#: Words of at least this share of all words are folded once for all texts.
HOT_SHARE = 1e-6
NONE = 2**31 - 1


@cache
def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _rank_json(path: str) -> str:
    cells: list[dict[str, int]] = [{} for _ in range(CELLS)]
    for piece, rank in ranks(path).items():
        text = piece.decode("latin-1")
        cells[zlib.crc32(text.encode()) % CELLS][text] = rank
    return json.dumps(cells, separators=(",", ":"))


def rank_map(path: str = VOCABULARY) -> Column:
    """The literal array of maps from a piece to its rank."""
    return F.from_json(F.lit(_rank_json(path)), "array<map<string,int>>")


def rank_of(piece: Column, table: Column) -> Column:
    return F.coalesce(F.try_element_at(F.element_at(table, (F.crc32(piece.cast("binary")) % CELLS + 1).cast("int")), piece), F.lit(NONE))


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_merges(word: Column, table: Column) -> Column:
    """Ids of a word given as Latin-1 characters of its bytes.

    The fold carries the pieces and the rank of each two neighbours together, so that a step looks two pieces up, whatever the word's length, and copies
    the rest.
    """
    size = F.length(word)
    bytes_ = F.transform(F.sequence(F.lit(1), size), lambda i: F.substr(word, i, F.lit(1)))
    start = F.struct(bytes_.alias("p"), F.transform(F.sequence(F.lit(1), size - 1), lambda i: rank_of(F.substr(word, i, F.lit(2)), table)).alias("r"))
    none = F.array().cast("array<int>")

    def step(state: Column, _: Column) -> Column:
        p, r = state["p"], state["r"]

        def merged(at: Column, new: Column) -> Column:
            left = F.when(at > 1, F.concat(F.slice(r, 1, at - 2), F.array(rank_of(F.concat(F.element_at(p, at - 1), new), table)))).otherwise(none)
            right = F.when(at < F.size(r), F.concat(F.array(rank_of(F.concat(new, F.element_at(p, at + 2)), table)), F.slice(r, at + 2, F.size(r)))).otherwise(none)
            return F.struct(F.concat(F.slice(p, 1, at - 1), F.array(new), F.slice(p, at + 2, F.size(p))).alias("p"), F.concat(left, right).alias("r"))

        # what is read more than once is computed once: the interpreter of higher-order functions shares nothing by itself
        merge = lambda at: let(F.concat(F.element_at(p, at), F.element_at(p, at + 1)), lambda new: merged(at, new))
        of_best = lambda best: F.when(best < NONE, let(F.array_position(r, best).cast("int"), merge)).otherwise(state)
        return F.when(F.size(r) > 0, let(F.array_min(r), of_best)).otherwise(state)

    folded = F.aggregate(F.sequence(F.lit(2), size), start, step, lambda state: state["p"])
    whole = rank_of(word, table)
    return let(whole, lambda r: F.when((r < NONE) | (size < 2), F.array(r)).otherwise(F.transform(folded, lambda p: rank_of(p, table))))


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


def latin(word: Column) -> Column:
    """A word's bytes as characters."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def _cell(word: Column) -> Column:
    return (F.crc32(word.cast("binary")) % CELLS + 1).cast("int")


def frequent_words(words: DataFrame, path: str = VOCABULARY) -> Column:
    """The literal array of maps from a frequent word to its ids, of (word), which is scanned once."""
    counts = checkpointed(words.groupBy("word").agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("n") >= max(2, total * HOT_SHARE)).select("word", let(rank_map(path), lambda table: fold_merges(latin(F.col("word")), table)).alias("ids"))
    cells: list[list[str]] = [[] for _ in range(CELLS)]
    for r in hot.collect():  # 1 / HOT_SHARE rows at most
        cells[zlib.crc32(r.word.encode()) % CELLS].append(f"{json.dumps(r.word)}:{json.dumps(r.ids, separators=(',', ':'))}")
    return F.from_json(F.lit("[" + ",".join("{" + ",".join(c) + "}" for c in cells) + "]"), "array<map<string,array<int>>>")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of each row's text."""
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))).select("id", words_of(F.col("t")).alias("words"))
    hot = frequent_words(rows.select(F.explode("words").alias("word")), path)
    ids_of = lambda table, known: lambda w: F.coalesce(F.try_element_at(F.element_at(known, _cell(w)), w), fold_merges(latin(w), table))
    # each literal stands in the plan once, however often it is read
    ids = let(rank_map(path), lambda table: let(hot, lambda known: F.flatten(F.transform("words", ids_of(table, known)))))
    return rows.select("id", ids.alias("ids"))


def decode(df: DataFrame, id_col: str = "id", ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """(id, text): the bytes of the ids, one after another, read as UTF-8."""
    pieces = [None] * (max(ranks(path).values()) + 1)
    for piece, rank in ranks(path).items():
        pieces[rank] = piece.hex()
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    hexed = F.array_join(F.transform(ids_col, lambda i: F.element_at(table, i + 1)), "")
    return df.select(F.col(id_col).alias("id"), F.decode(F.unhex(hexed), "UTF-8").alias("text"))

"""SentencePiece encoding and decoding over a relational lattice.

A text is written with U+2581 for spaces, one more in front, and falls into segments at spaces and line feeds, which no
piece crosses. The lattice of a segment has an edge for every substring that is a piece: substrings of bounded length are
exploded, joined with the piece table (broadcast, a fixed number of rows), grouped by segment, and a higher-order aggregate
folds Viterbi over the places of the segment. A character that no piece covers alone gets an edge of its UTF-8 bytes.

Edges cost -score of their piece; models whose scores are merge ranks, as byte-pair ones, cost 10000 ln(rank + 2), which
grows as the surprise of the piece under Zipf's law. Costs are integers; ties go to fewer pieces, then to the longer last
piece. The segmentation is therefore Viterbi's, the cheapest, not the one of successive merges.

The relational lattice encodes the lexicon, at most ``lexicon`` of the most frequent segments of up to ``MAX_SEGMENT`` characters,
nine tenths of a corpus' words. A fixed number of rows, it is broadcast, and documents are encoded without a shuffle of their
text, by look-up; segments beyond the lexicon run through the same lattice and fold in the task that holds them.

Defined results: a null text has null ids, an empty one no ids; ids always decode to the text (with U+2581 read as a space,
as SentencePiece does); repeated rows give repeated results; extra columns stay as they are, but one
named like the result, which is replaced; very long texts and segments are encoded whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quadrat.llm.common import cut, in_batches, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LEXICON = 1 << 18
#: Frequent segments that a task passes on, and the distinct ones that it counts before it drops the rarest.
TASK_LEXICON = 1 << 16
TASK_COUNTED = 1 << 19
MAX_SEGMENT = 40
#: Steps of counts a doubling, in the search for the least frequency of the lexicon.
LEVELS = 32
#: Partitions of the lexicon, which has a fixed number of rows.
LEXICON_PARTS = 24
#: Segments beyond the lexicon that a task remembers.
MEMORY = 1 << 16
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
BYTE_COST = 150_000
#: More than a segment has pieces: cost * PIECES + pieces orders paths by cost, then by pieces.
PIECES = 1 << 32
NEVER = 1 << 200


class Pieces:
    """Piece, id and integer cost of a model, and the ids of its byte pieces."""

    def __init__(self, path: str = MODEL) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        ranked = all(m.get_score(i) == round(m.get_score(i)) for i in plain)
        cost = lambda i: round(10_000 * (math.log(2 - m.get_score(i)) if ranked else -m.get_score(i)))
        self.cost = {m.id_to_piece(i): (cost(i), i) for i in plain}
        self.singles = {p for p in self.cost if len(p) == 1}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.cost))
        self.text = {i: m.id_to_piece(i).encode() for i in plain} | {i: bytes([b]) for b, i in enumerate(self.bytes)}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """All pieces, with length, key and ids."""
        a = ahocorasick.Automaton()
        for p, (c, i) in self.cost.items():
            a.add_word(p, (len(p), c * PIECES + 1, (i,)))
        a.make_automaton()
        return a

    def hex_text(self) -> Column:
        """The bytes of every piece in hexadecimal, by id: a literal of a fixed size."""
        return F.split(F.lit(",".join(self.text.get(i, b"").hex() for i in range(max(self.text) + 1))), ",")

    def table(self, spark: SparkSession) -> DataFrame:
        """piece, id, cost: a row for each piece of the model."""
        return spark.createDataFrame([(p, i, c) for p, (c, i) in self.cost.items()], "piece string, id int, cost long")


def runs(text: str):
    """The segments of a text by ``SEGMENT``, in order, in lists: (segments, False), or (words, True) if each word stands for a
    segment of one space and the word. Lines with single spaces only are split at these, which needs no new strings."""
    for k, line in enumerate(text.split("\n") if text else ()):
        if k:
            yield ["\n"], False
        if SPACE in line or "  " in line or line[:1] == " " or line[-1:] == " ":
            yield SEGMENT.findall(("" if k else SPACE) + line.replace(" ", SPACE)), False
            continue
        words = line.split(" ")
        if k and words[0]:
            yield words[:1], False
        yield words[1:] if k else words, True


def segments(text: str) -> list[str]:
    return [SPACE + w if spaced else w for words, spaced in runs(text) for w in words]


def viterbi(segment: str, pieces: Pieces) -> list[int]:
    """The cheapest path through one segment's lattice, outside Spark: keys order paths by cost, then by pieces."""
    own = set(segment)
    known = pieces.singles.issuperset(own)
    best, back = [0] + [NEVER] * len(segment), [None] * (len(segment) + 1)
    done = 0  # places up to here have their best path
    for last, (length, key, ids) in pieces.automaton.iter(segment):  # by ends; longer pieces first, which wins ties
        if not known:
            while done < last:
                done += 1
                _by_bytes(segment, done, best, back, pieces)
        c = best[last + 1 - length] + key
        if c < best[last + 1]:
            best[last + 1], back[last + 1] = c, (last + 1 - length, ids)
    if not known:
        for end in range(done + 1, len(segment) + 1):
            _by_bytes(segment, end, best, back, pieces)
    out: list[tuple] = []
    n = len(segment)
    while n:
        n, ids = back[n]
        out.append(ids)
    return [i for ids in reversed(out) for i in ids]


def _by_bytes(segment: str, end: int, best: list, back: list, pieces: Pieces) -> None:
    """The path that ends with the bytes of a character that is no piece."""
    char = segment[end - 1]
    if char not in pieces.singles:
        raw = char.encode("utf-8", "surrogatepass")
        c = best[end - 1] + len(raw) * (BYTE_COST * PIECES + 1)
        if c < best[end]:
            best[end], back[end] = c, (end - 1, tuple(pieces.bytes[b] for b in raw))


def frequent_segments(docs: DataFrame, text: str, most: int = LEXICON) -> DataFrame:
    """w: the segments that are most frequent by the tasks' counts of all texts; of those as frequent as one another, up to a
    step of counts, either all or none, so that at most ``most`` are found without sorting them in one task."""

    def count(batches):
        seen: Counter[str] = Counter()
        after: Counter[str] = Counter()  # of words behind one space
        for b in batches:
            for t in b.column(0).to_pylist():
                for words, spaced in runs(t or ""):
                    (after if spaced else seen).update(words)
                if len(after) > TASK_COUNTED:
                    after = Counter(dict(after.most_common(TASK_COUNTED // 2)))
                if len(seen) > TASK_COUNTED:
                    seen = Counter(dict(seen.most_common(TASK_COUNTED // 2)))
        for w, n in after.most_common(TASK_LEXICON):
            seen[SPACE + w] += n
        top = [(w, n) for w, n in seen.most_common(TASK_LEXICON) if len(w) <= MAX_SEGMENT]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["w", "n"])

    counts = cut(docs.select(text).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "counts")
    level = F.floor(F.log2("n") * LEVELS).cast("int")
    left, least = most, None
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():  # at most 64 * LEVELS rows
        left -= r["words"]
        if left < 0:
            break
        least = r["level"]
    return counts.where(level >= least if least is not None else F.lit(False)).select("w").repartition(LEXICON_PARTS, "w")


def lattice_edges(words: DataFrame, table: DataFrame, longest: int, byte_ids: list[int]) -> DataFrame:
    """w, edges: each word with its lattice, an array of end, start, ids, cost in order of the ends."""
    n = F.char_length("w")
    starts = words.select("w", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    cuts = starts.select("w", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("s")))).alias("len"))
    parts = cuts.select("w", "s", "len", F.substring("w", F.col("s") + 1, F.col("len")).alias("piece"))
    joined = parts.join(F.broadcast(table), "piece", "left").where("id is not null or len = 1")  # the piece table has a fixed size
    raw = F.transform(F.sequence(F.lit(0), F.octet_length("piece") - 1), lambda k: F.conv(F.hex(F.substring(F.encode("piece", "UTF-8"), k + 1, F.lit(1))), 16, 10).cast("int"))
    of_bytes = F.transform(raw, lambda b: F.get(F.array(*map(F.lit, byte_ids)), b))
    ids = F.when(F.col("id").isNotNull(), F.array("id")).otherwise(of_bytes)
    cost = F.coalesce("cost", F.octet_length("piece").cast("long") * BYTE_COST)
    edge = F.struct((F.col("s") + F.col("len")).alias("e"), "s", ids.alias("ids"), cost.alias("cost"))
    return joined.select("w", edge.alias("edge")).groupBy("w").agg(F.array_sort(F.collect_list("edge")).alias("edges"))


def fold_viterbi(word: Column, edges: Column) -> Column:
    """The ids of the cheapest path: a fold over the places of the word, holding the best path to each."""
    start = F.array(F.struct(F.lit(0).cast("long").alias("cost"), F.lit(0).alias("n"), F.lit(0).alias("neg_len"), F.array().cast("array<int>").alias("ids")))

    def place(acc: Column, end: Column) -> Column:
        def path(e: Column) -> Column:
            before = F.get(acc, e["s"])
            return F.struct((before["cost"] + e["cost"]).alias("cost"), (before["n"] + F.size(e["ids"])).alias("n"), (e["s"] - e["e"]).alias("neg_len"), F.concat(before["ids"], e["ids"]).alias("ids"))

        return F.concat(acc, F.array(F.array_min(F.transform(F.filter(edges, lambda e: e["e"] == end), path))))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(word)), start, place, lambda acc: F.element_at(acc, -1)["ids"])


def encode_lexicon(words: DataFrame, pieces: Pieces) -> DataFrame:
    """w, ids of every word (no empty ones), by the relational lattice."""
    edges = lattice_edges(words.distinct(), pieces.table(words.sparkSession), pieces.longest, pieces.bytes)
    return edges.select("w", fold_viterbi(F.col("w"), F.col("edges")).alias("ids"))


def encode(docs: DataFrame, text: str = "text", out: str = "piece_ids", pieces: Pieces | None = None, lexicon: int = LEXICON, count_unknown: str | None = None) -> DataFrame:
    """The documents with the ids of their pieces, in the place of a column of that name if there is one."""
    pieces = pieces or Pieces()
    docs = in_batches(docs).drop(out)
    known = cut(encode_lexicon(frequent_segments(docs, text, lexicon), pieces), "lexicon").toArrow()  # at most ``lexicon`` rows
    ids = known.column("ids").combine_chunks()
    flat, ends = ids.flatten().to_numpy().astype(np.int32), np.cumsum([0, *ids.value_lengths().to_pylist()])
    table, after = {}, {}  # after: of words behind one space, by the word
    for k, w in enumerate(known.column("w").to_pylist()):
        spaced = w[0] == SPACE and SPACE not in w[1:]
        (after if spaced else table)[w[spaced:]] = flat[ends[k] : ends[k + 1]].tobytes()
    shared = docs.sparkSession.sparkContext.broadcast((table, after, pieces))
    rows = docs.schema

    def run(batches):
        table, after, pieces = shared.value
        memory: dict[str, bytes] = {}

        def find(w: str) -> bytes:
            got = memory.get(w)
            if got is None:
                if len(memory) >= MEMORY:
                    memory.clear()
                got = memory[w] = np.array(viterbi(w, pieces), np.int32).tobytes()
            return got

        for b in slices(batches):
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            values, offsets = [], [0]
            for t in texts:
                parts: list[bytes] = []
                for words, spaced in runs(t or ""):
                    got = list(map((after if spaced else table).get, words))
                    if None in got:
                        got = [x or find(SPACE + w if spaced else w) for x, w in zip(got, words, strict=True)]
                    parts += got
                values.append(b"".join(parts))
                offsets.append(offsets[-1] + len(values[-1]) // 4)
            flat = pa.array(np.frombuffer(b"".join(values), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array([t is None for t in texts], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, out])

    return docs.mapInArrow(run, StructType([*rows.fields, StructField(out, ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, ids: str = "piece_ids", out: str = "decoded", pieces: Pieces | None = None) -> DataFrame:
    """The rows with the text that their ids stand for, by look-up in a literal; bytes are joined before they become text."""
    table = (pieces or Pieces()).hex_text()
    data = F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))
    text = F.replace(data.cast("string"), F.lit(SPACE), F.lit(" "))
    return encoded.withColumn(out, F.substring(text, 2, 2**31 - 1))


def decode_ids(ids, pieces: Pieces) -> str:
    """One text from its ids, outside Spark."""
    return b"".join(pieces.text[i] for i in ids).decode("utf-8", "surrogatepass").replace(SPACE, " ")[1:]

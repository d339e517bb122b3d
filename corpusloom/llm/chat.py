"""Transcript parsing and canonical chat turns (operator 2).

A transcript is a sequence of entries; an entry is a stored row, or a part of one where a
line opens with a speaker marker ("User:", "Assistant:", ...). A hidden Markov model with
one state for each role scores entries by their speaker marker (a marker in the text, else
the stored role where it is recognised) and by line features: the length and whether the
entry ends in a question mark. Viterbi recovers the roles; runs of a role become one turn.

A conversation may be of any length. Entries are range-sorted, so that a long conversation
spans tasks; each task reduces its piece of a conversation that crosses a border to a small
max-plus matrix, the driver joins these (at most two for each task) into the best states at
the borders, and each task then decodes its own pieces exactly.

The model's counts come from all entries with a recognised role and all pairs of them that
follow one another, whatever their turn numbers; a few dozen sums for each task reach
the driver. Defined results: null or empty texts are entries with empty content; null turns
come first; rows of equal (conversation, turn) follow in an order set by their content, and
repeated rows are entries of their own; null conversations form one transcript; without any
recognised role, priors alone decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.base import quoted, shared_dir

ROLES = ("system", "user", "assistant")
#: Fixed: words that mark a speaker at the start of a line, by role.
MARKERS = {"system": ("system", "instructions"), "user": ("user", "human", "customer", "question", "q"), "assistant": ("assistant", "ai", "bot", "agent", "answer", "a")}
BUCKETS = 16
#: How far a marker is believed; counts that every event starts with.
TRUST, PRIOR = 0.97, 1.0
_WORDS = "|".join(w for ws in MARKERS.values() for w in sorted(ws, key=len, reverse=True))
MARKER = rf"^[\s>*#\[<|]*(?i:({_WORDS}))[\s*\]>|]*:[ \t]*"


def _role_of(word: Column) -> Column:
    """The number of the role that a marker word names; null for others."""
    out = None
    for i, role in enumerate(ROLES):
        test = F.lower(F.trim(word)).isin(*MARKERS[role])
        out = F.when(test, i) if out is None else out.when(test, i)
    return out


def entries(df: DataFrame, conv: str, turn: str, role: str, text: str, keep: str | None = None) -> DataFrame:
    """Entries ``(conv, turn, rid, seg, marker, bucket, asks, content, kept)``; one for each row or marked part of one."""
    own = F.coalesce(quoted(text), F.lit(""))
    parts = F.split(own, rf"\n(?=[\s>*#\[<|]*(?i:{_WORDS})[\s*\]>|]*:)", -1)
    rows = df.select(
        quoted(conv).alias("conv"), quoted(turn).alias("turn"), F.xxhash64(quoted(role), own).alias("rid"), _role_of(quoted(role)).alias("stored"),
        (quoted(keep) if keep else F.lit(None)).cast("string").alias("kept"), F.posexplode(parts).alias("seg", "part"),
    )
    written = _role_of(F.regexp_extract("part", MARKER, 1))
    content = F.regexp_replace(F.when(written.isNotNull(), F.regexp_replace("part", MARKER, "")).otherwise(F.col("part")), r"^\s+|\s+$", "")
    out = rows.select("conv", "turn", "rid", "seg", F.coalesce(written, F.when(F.col("seg") == 0, F.col("stored")), F.lit(-1)).cast("int").alias("marker"), content.alias("content"), "kept")
    bucket = F.least(F.floor(F.log2(F.length("content") + 1.0)), F.lit(BUCKETS - 1)).cast("int")
    return out.select("conv", "turn", "rid", "seg", "marker", bucket.alias("bucket"), F.col("content").rlike(r"[?？][\"')\]]*$").cast("int").alias("asks"), "content", "kept")


@dataclass
class Hmm:
    start: np.ndarray
    trans: np.ndarray
    emit: np.ndarray  # (marker + 1, bucket, asks, role)

    def score(self, marker: int, bucket: int, asks: int) -> np.ndarray:
        return self.emit[marker + 1, bucket, asks]


def count_events(rows: list[tuple], counts: np.ndarray, starts: np.ndarray, moves: np.ndarray, begins: bool) -> tuple[int, int]:
    """Adds the entries of one piece of a conversation to the sums; ``begins`` is false where the piece's start isn't known. Its first and last marker."""
    last = None
    for r in rows:
        m = r[4]
        if m >= 0:
            counts[r[5], r[6], m] += 1
            if last is None:
                if begins:
                    starts[m] += 1
            elif last >= 0:
                moves[last, m] += 1
        last = m
    return rows[0][4], rows[-1][4]


def fit(dealt: DataFrame, conv_arrow: pa.DataType) -> Hmm:
    """Parameters from the sums of each task over its marked entries and neighbours, and from the neighbours at the borders of tasks."""
    k = len(ROLES)
    sizes = (BUCKETS * 2 * k, k, k * k)
    conv_type = dealt.schema["conv"].dataType

    def tally(batches):
        counts, starts, moves = np.zeros((BUCKETS, 2, k)), np.zeros(k), np.zeros((k, k))
        first = last = None
        for pid, c, rows in _pieces(batches):
            ends = count_events(rows, counts, starts, moves, first is not None)
            first = first or (pid, c, ends[0])
            last = (c, ends[1])
        if first:
            sums = np.concatenate([counts.ravel(), starts, moves.ravel()]).tolist()
            cols = [pa.array([first[0]], pa.int32()), *[pa.array([x], t) for x, t in ((first[1], conv_arrow), (first[2], pa.int32()), (last[0], conv_arrow), (last[1], pa.int32()))], pa.array([sums], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["pid", "first", "opens", "last", "ends", "sums"])

    fields = [("pid", T.IntegerType()), ("first", conv_type), ("opens", T.IntegerType()), ("last", conv_type), ("ends", T.IntegerType()), ("sums", T.ArrayType(T.DoubleType()))]
    total = np.zeros(sum(sizes))
    before = None
    for r in sorted(dealt.mapInArrow(tally, T.StructType([T.StructField(n, t) for n, t in fields])).collect(), key=lambda r: r["pid"]):
        total += np.array(r["sums"])
        if r["opens"] >= 0:
            if before is None or before["last"] != r["first"]:
                total[sizes[0] + r["opens"]] += 1
            elif before["ends"] >= 0:
                total[sizes[0] + k + before["ends"] * k + r["opens"]] += 1
        before = r
    counts, starts, moves = np.split(total, np.cumsum(sizes)[:2])
    feats = counts.reshape(BUCKETS, 2, k) + PRIOR / BUCKETS
    start, trans = starts + PRIOR, moves.reshape(k, k) + PRIOR
    feats = np.log(feats / feats.sum(axis=(0, 1)))
    emit = np.empty((k + 1, BUCKETS, 2, k))
    emit[0] = feats
    for m in range(k):
        emit[m + 1] = feats + np.log([TRUST if s == m else (1 - TRUST) / (k - 1) for s in range(k)])
    return Hmm(np.log(start / start.sum()), np.log(trans / trans.sum(axis=1, keepdims=True)), emit)


def viterbi(hmm: Hmm, seen: list[np.ndarray], entry: int | None = None, leave: int | None = None) -> list[int]:
    """The best roles for scores ``seen``, given the role before them and the role of the last, where known."""
    if not seen:
        return []
    best, back = (hmm.start if entry is None else hmm.trans[entry]) + seen[0], []
    for s in seen[1:]:
        step = best[:, None] + hmm.trans
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + s
    at = int(best.argmax()) if leave is None else leave
    out = [at]
    for b in reversed(back):
        at = int(b[at])
        out.append(at)
    return out[::-1]


def reduce_piece(hmm: Hmm, seen: list[np.ndarray]) -> np.ndarray:
    """Max-plus matrix: row i for role i before the piece, a last row for a piece that begins its conversation."""
    m = np.vstack([hmm.trans + seen[0], hmm.start + seen[0]])
    for s in seen[1:]:
        m = (m[:, :, None] + hmm.trans[None]).max(axis=1) + s
    return m


def join_pieces(pieces: list[np.ndarray]) -> list[tuple[int | None, int]]:
    """(role before, role of the last entry) for the pieces of one conversation, in order."""
    value, back = pieces[0][-1], []
    for m in pieces[1:]:
        step = value[:, None] + m[:-1]
        back.append(step.argmax(axis=0))
        value = step.max(axis=0)
    last = [int(value.argmax())]
    for b in reversed(back):
        last.append(int(b[last[-1]]))
    last.reverse()
    return [(None if i == 0 else last[i - 1], at) for i, at in enumerate(last)]


def _pieces(batches):
    """Consecutive entries of one conversation: (pid, conv, rows), rows as lists of columns."""
    pid = conv = None
    held: list[list] | None = None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols):
            if held is None or row[1] != conv:
                if held:
                    yield pid, conv, held
                pid, conv, held = row[0], row[1], []
            held.append(row)
    if held:
        yield pid, conv, held


def parse(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", keep: str | None = None) -> DataFrame:
    """``(conv, turn, seg int, seq long, role_pred, new_turn boolean, rendered)`` of every entry, and the string column ``keep`` of its row where one is named.

    ``seq`` numbers the entries of a conversation. The ``rendered`` strings of a conversation, in that order, are its canonical
    transcript: turns ``<|role|>``, content, ``<|end|>``, where entries after a turn's first add a line to it
    and a turn's end stands before the next turn's role.
    """
    spark = df.sparkSession
    place = ["conv", "turn", "rid", "seg"]
    rows = entries(df, conv, turn, role, text, keep).repartitionByRange(*place).sortWithinPartitions(*place)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    # Checkpointed, not written as a table: tasks must keep their rows and the order of them.
    dealt = rows.select(F.spark_partition_id().alias("pid"), "conv", "turn", "seg", "marker", "bucket", "asks", "content", "kept").checkpoint()
    conv_type, turn_type = dealt.schema["conv"].dataType, dealt.schema["turn"].dataType
    conv_arrow, turn_arrow = to_arrow_type(conv_type), to_arrow_type(turn_type)
    shared = spark.sparkContext.broadcast(fit(dealt, conv_arrow))

    def borders(batches):
        ends, count = [], 0
        for pid, c, rows in _pieces(batches):
            ends = [*ends[:1], (pid, count, c, rows)]
            count += 1
        matrices = [reduce_piece(shared.value, [shared.value.score(*r[4:7]) for r in e[3]]).ravel().tolist() for e in ends]
        if ends:
            cols = [pa.array([e[0] for e in ends], pa.int32()), pa.array([e[1] for e in ends], pa.int64()), pa.array([e[2] for e in ends], conv_arrow), pa.array([len(e[3]) for e in ends], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(matrices, pa.list_(pa.float64()))], names=["pid", "at", "conv", "n", "m"])

    fields = [("pid", T.IntegerType()), ("at", T.LongType()), ("conv", conv_type), ("n", T.LongType()), ("m", T.ArrayType(T.DoubleType()))]
    ends = sorted(dealt.mapInArrow(borders, T.StructType([T.StructField(n, t) for n, t in fields])).collect(), key=lambda r: (r["pid"], r["at"]))
    known = spark.sparkContext.broadcast(across_borders(ends))

    def decode(batches):
        count, out = 0, []
        for pid, c, rows in _pieces(batches):
            before, leave, final, seq = known.value.get((pid, count), (None, None, True, 0))
            count += 1
            path = viterbi(shared.value, [shared.value.score(*r[4:7]) for r in rows], before, leave)
            for i, (r, at) in enumerate(zip(rows, path)):
                opening = "\n" if at == before else f"<|{ROLES[at]}|>\n" if before is None else f"\n<|end|>\n<|{ROLES[at]}|>\n"
                closing = "\n<|end|>\n" if final and i + 1 == len(rows) else ""
                out.append((c, r[2], r[3], seq + i, ROLES[at], at != before, opening + r[7] + closing, r[8]))
                before = at
                if len(out) == 4096:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    names = [conv, turn, "seg", "seq", "role_pred", "new_turn", "rendered", keep or "__kept"]
    kinds = [conv_arrow, turn_arrow, pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    out = [conv_type, turn_type, T.IntegerType(), T.LongType(), T.StringType(), T.BooleanType(), T.StringType(), T.StringType()]
    done = dealt.mapInArrow(decode, T.StructType([T.StructField(n, k) for n, k in zip(names, out)]))
    return done if keep else done.drop("__kept")


def across_borders(ends) -> dict[tuple[int, int], tuple[int | None, int, bool, int]]:
    """For pieces of conversations that cross tasks: role before, role of the last entry, whether the conversation ends, entries ahead."""
    fixed: dict[tuple[int, int], tuple[int | None, int, bool, int]] = {}
    chain: list = []
    for r in [*ends, None]:
        if chain and (r is None or r["conv"] != chain[-1]["conv"]):
            if len(chain) > 1:
                states = join_pieces([np.array(x["m"]).reshape(len(ROLES) + 1, len(ROLES)) for x in chain])
                ahead = 0
                for i, (x, s) in enumerate(zip(chain, states)):
                    fixed[(x["pid"], x["at"])] = (*s, i + 1 == len(chain), ahead)
                    ahead += x["n"]
            chain = []
        chain.append(r)
    return fixed


#: Entries of one transcript part.
PART = 1000


def transcripts(parsed: DataFrame, conv: str = "conv_id", part: int = PART, **sums: Column) -> DataFrame:
    """``(conv, part, n_entries, n_turns, transcript)`` and sums: one row for each conversation, further parts for one of more than ``part`` entries.

    The parts of a conversation, in order, are its whole transcript; no task gathers more than a part.
    """
    own = F.call_function("div", F.col("seq"), F.lit(part)).cast("int")
    line = F.struct("seq", "rendered")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["rendered"]), "")
    return parsed.groupBy(quoted(conv).alias(conv), own.alias("part")).agg(
        F.count("*").alias("n_entries"), F.count_if("new_turn").alias("n_turns"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in sums.items()], whole.alias("transcript")
    )

"""Masked pseudo-likelihood: a window network predicts every token from both sides; documents sum its log-probabilities.

Tokens are the corpus's commonest words (counted over all documents) and, for other words, classes of shape. A word of
a shape has its shape's probability times its own share of the shape, by its count: all words that occur ``LEAST``
times have their own, so the vocabulary grows with the corpus; rarer words, and those that the corpus doesn't have,
share what is left by how they are spelled (each byte by the one before it, counted over the corpus).
The network adds up an embedding of each of the six tokens around a place (one table a place); a tanh layer feeds two
softmaxes, over groups of tokens of like frequency and over the tokens of a group, so that thousands of tokens cost no
more than two short rows. It is trained in numpy: documents are dealt to buckets by a hash of their id and text, as
many buckets as the corpus has words for; in each, SGD (Adagrad) runs over every place of its documents, half of them
in each of two rounds, after which the buckets' models are averaged. Neither buckets nor their order depend on how the
input is partitioned, so scores don't either.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm import textnum as tn
from tomewright.llm.common import drop_table, only, read_table, stage_table

#: Groups of tokens and tokens of a group; shape tokens; least count of a word with a probability of its own.
GROUPS, SLOTS, SHAPES, LEAST = 64, 64, 32, 20
#: Commonest words, which are tokens; all tokens, of which 0 stands beyond either end of a text.
COMMON = GROUPS * SLOTS - SHAPES
TOKENS = 1 + GROUPS * SLOTS
SIDE, WIDTH, ROUNDS, BATCH, RATE, SEED = 3, 16, 2, 8192, 0.2, 5
PLACES = tuple(d for d in range(-SIDE, SIDE + 1) if d)
#: Words of a bucket, about; places that are held at once in training; parameters in a row of the averaging shuffle.
BUCKET_WORDS, HELD, CHUNK = 2_000_000, 1 << 18, 1024
#: Words whose shares are sent to executors (12 bytes each); beyond, shares are joined.
MOST_SENT = 4_000_000
#: Embeddings by place; weights of the groups; weights of the tokens of each group. The last hidden unit is constant.
_SHAPES_OF = ((len(PLACES), TOKENS, WIDTH), (WIDTH, GROUPS), (GROUPS, WIDTH, SLOTS))
_SIGN, _UPPER = np.zeros(256, bool), np.zeros(256, bool)
_SIGN[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,"]] = True
_UPPER[65:91] = True


class Vocabulary(NamedTuple):
    """Tokens, and the shares of words in their tokens: an array if it is small enough to be sent, else a table."""

    common: np.ndarray  # hashes of the commonest words, sorted
    token: np.ndarray  # by common word
    shape_token: np.ndarray  # by shape
    words: np.ndarray  # hashes of the words that occur LEAST times, sorted; none if they are in a table
    share: np.ndarray  # by word: log of its part of its token
    rest: np.ndarray  # by shape: log of all other words' part
    spelling: np.ndarray  # by byte and the byte before it: log-probability
    by_token: np.ndarray  # occurrences
    table: DataFrame | None = None  # word, share

    @property
    def sent(self) -> Vocabulary:
        return self._replace(table=None)


class Places(NamedTuple):
    hashes: np.ndarray


def _shapes(w: tn.Words) -> np.ndarray:
    sums = [np.zeros(len(w.data) + 1, np.int64) for _ in range(2)]
    for s, mask in zip(sums, (_SIGN, _UPPER), strict=True):
        np.cumsum(mask[w.data], out=s[1:])
    sign, upper = ((s[w.ends] - s[w.starts]) > most for s, most in zip(sums, (0, 1), strict=True))
    return (sign * 2 + upper) * 8 + np.searchsorted([2, 3, 4, 6, 9, 13, 19], w.ends - w.starts)


_LEADS: dict[int, tuple[np.ndarray, np.uint64, np.ndarray]] = {}


def _find(sorted_hashes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of hashes in a sorted array, or -1: by their leading bits (a table that is kept), then step by step."""
    out = np.full(len(hashes), -1)
    if not len(sorted_hashes):
        return out
    if id(sorted_hashes) not in _LEADS:
        if len(_LEADS) > 3:
            _LEADS.clear()
        shift = np.uint64(64 - (2 * len(sorted_hashes)).bit_length())
        ends = np.cumsum(np.bincount((sorted_hashes >> shift).astype(np.int64), minlength=1 << (64 - int(shift))))
        _LEADS[id(sorted_hashes)] = sorted_hashes, shift, np.r_[0, ends].astype(np.int32)
    _, shift, begin = _LEADS[id(sorted_hashes)]
    lead = (hashes >> shift).astype(np.int64)
    at, end = begin[lead], begin[lead + 1]
    left = np.flatnonzero(at < end)
    at, end = at[left], end[left]
    while len(left):
        hit = sorted_hashes[at] == hashes[left]
        out[left[hit]] = at[hit]
        more = ~hit & (at + 1 < end)
        left, at, end = left[more], at[more] + 1, end[more]
    return out


def _spelled(w: tn.Words) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of bytes, as numbers of two bytes: of each byte of the data with the one before, and at the words' ends.
    White space is one kind of byte."""
    pairs = np.full(len(w.data), 32 << 8, np.uint16)
    pairs[1:] = w.data[:-1].astype(np.uint16) << 8
    pairs[w.starts] = 32 << 8
    pairs |= w.data
    return pairs, w.data[w.ends - 1].astype(np.uint16) << 8 | 32


def spelling_logs(w: tn.Words, spelling: np.ndarray) -> np.ndarray:
    """Log-probability of each word's bytes and of its end."""
    pairs, ends = _spelled(w)
    sums = np.zeros(len(pairs) + 1)
    np.cumsum(spelling[pairs], out=sums[1:])
    return sums[w.ends] - sums[w.starts] + spelling[ends]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, shape, n``: occurrences of every hashed word over all documents; shape -1: of every pair of bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bytes_seen = ["word", "shape", "n"], np.zeros(1 << 16, np.int64)
        for batch in batches:
            for _, _, w in tn.token_pieces(batch.column(0)):
                pairs, ends = _spelled(w)
                pairs = np.bincount(pairs, minlength=1 << 16)
                pairs.reshape(256, 256)[:, tn._SPACE] = 0
                bytes_seen += pairs + np.bincount(ends, minlength=1 << 16)
                words, at, n = np.unique(w.hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(_shapes(w)[at]), pa.array(n)], names=names)
        at = np.flatnonzero(bytes_seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), -1)), pa.array(bytes_seen[at])], names=names)

    kind = "word bigint, shape bigint, n bigint"
    return only(docs, text_col).mapInArrow(count, kind).groupBy("word", "shape").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, text_col: str = "text", most_sent: int = MOST_SENT) -> Vocabulary:
    """What the corpus's word counts give. The driver gets the ``COMMON`` commonest words, some numbers a shape and a
    pair of bytes and, if there are ``most_sent`` of them at most, the words that occur ``LEAST`` times; else these stay in a table."""
    counts = stage_table(word_counts(docs, text_col), "lm-word-counts")
    often = counts.where((F.col("shape") >= 0) & (F.col("n") >= LEAST))
    top = often.orderBy(F.desc("n"), "word").limit(COMMON).toPandas()
    rare_n = F.sum(F.when(F.col("n") < LEAST, F.col("n")).otherwise(0)).alias("rare")
    n_often = F.count(F.when(F.col("n") >= LEAST, 1)).alias("often")
    sizes = counts.where("shape >= 0").groupBy("shape").agg(F.sum("n").alias("n"), rare_n, n_often).toPandas()
    total, rare = np.zeros(SHAPES), np.zeros(SHAPES)
    for out, column in ((total, "n"), (rare, "rare")):
        out[sizes["shape"].to_numpy(np.int64)] = sizes[column].to_numpy(np.float64)
    pairs = counts.where("shape = -1").toPandas()
    spelled = np.ones(1 << 16)
    spelled[pairs["word"].to_numpy(np.int64)] += pairs["n"].to_numpy(np.float64)
    spelled = spelled.reshape(256, 256)
    spelling = np.log(spelled / spelled.sum(1, keepdims=True)).ravel().astype(np.float32)
    common, n_common = top["word"].to_numpy(np.int64), top["n"].to_numpy(np.float64)
    total -= np.bincount(top["shape"].to_numpy(np.int64), weights=n_common, minlength=SHAPES)
    # tokens in the order of their counts: a group's tokens are of like frequency
    weight = np.r_[n_common, total]
    rank = np.empty(len(weight), np.int64)
    rank[np.argsort(-weight, kind="stable")] = np.arange(len(weight))
    by_token = np.zeros(TOKENS)
    by_token[1 + rank] = weight
    # one occurrence more: those that the corpus doesn't have
    rest = np.log((rare + 1) / (total + 1))
    totals = F.element_at(F.array(*map(F.lit, total.tolist())), (F.col("shape") + 1).cast("int"))
    own = docs.sparkSession.createDataFrame([(w, True) for w in common.tolist()], "word bigint, is_common boolean")
    share = F.when(F.col("is_common"), 0.0).otherwise(F.log(F.col("n") / (totals + 1)))
    shares = often.join(F.broadcast(own), "word", "left").select("word", share.cast("float").alias("share"))
    order = np.argsort(common.view(np.uint64))
    made = (common.view(np.uint64)[order], 1 + rank[: len(common)][order], 1 + rank[len(common) :])
    if int(sizes["often"].sum()) > most_sent:
        table = stage_table(shares, "lm-shares")
        drop_table(counts)
        return Vocabulary(*made, np.zeros(0, np.uint64), np.zeros(0, np.float32), rest, spelling, by_token, table)
    kept = shares.toPandas()
    drop_table(counts)
    words = kept["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    return Vocabulary(*made, words[order], kept["share"].to_numpy(np.float32)[order], rest, spelling, by_token)


def _encode(w: tn.Words, table: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its token, the log of its part of the token, and whether the token is a shape.

    A word of a shape that isn't among ``table.words`` is spelled, as if it were rare.
    """
    own, share = table.shape_token[_shapes(w)], np.zeros(len(w.hashes))
    at = _find(table.common, w.hashes)
    own[at >= 0] = table.token[at[at >= 0]]
    shaped = at < 0
    share[shaped] = (table.rest[_shapes(w)] + spelling_logs(w, table.spelling))[shaped]
    at = _find(table.words, w.hashes)
    share[at >= 0] = table.share[at[at >= 0]]
    return own, share, shaped


def encode_documents(docs: DataFrame, table: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, tokens, share``: a text's tokens, two bytes each, and the sum of its words' log shares.

    Where the vocabulary is too large to be sent, ``words`` are those that a table is to be asked for: word, number,
    and the log share with which it was summed.
    """
    sent = docs.sparkSession.sparkContext.broadcast(table.sent)
    joined = table.table is not None
    names = [id_col, "n_tokens", "tokens", "share", *["words"] * joined]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for i, j, w in tn.token_pieces(batch.column(1)):
                own, share, shaped = _encode(w, table)
                sums, raw = np.r_[0, np.cumsum(share)], own.astype("<u2").tobytes()
                tokens = [raw[2 * a : 2 * b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
                total = np.where(np.diff(w.first) > 0, sums[w.first[1:]] - sums[w.first[:-1]], 0.0)
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(w.first)), pa.array(tokens, pa.binary()), pa.array(total)]
                yield pa.RecordBatch.from_arrays([*columns, *[_asked(w, share, shaped)] * joined], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, tokens binary, share double" + ", words array<struct<word: bigint, n: bigint, rest: double>>" * joined
    return only(docs, id_col, text_col).mapInArrow(run, schema)


def _asked(w: tn.Words, share: np.ndarray, shaped: np.ndarray) -> pa.Array:
    at, owner = np.flatnonzero(shaped), tn.owners(w.first)
    at = at[np.lexsort((w.hashes[at], owner[at]))]
    words, of, rest = w.hashes[at], owner[at], share[at]
    begin = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.zeros(0, np.int64)
    fields = [pa.array(words[begin].view(np.int64)), pa.array(np.diff(np.r_[begin, len(of)])), pa.array(rest[begin])]
    offsets = np.searchsorted(of[begin], np.arange(len(w.first)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names=["word", "n", "rest"]))


def _streams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Texts i:j of a column of tokens as one array, with SIDE tokens 0 before and behind each, in pieces of about HELD."""
    data, bounds = tn.buffers(column)
    for i, j in tn.pieces(data, bounds, 2 * HELD):
        n = np.diff(bounds[i : j + 1]) // 2
        own = data[bounds[i] : bounds[j]].view("<u2")
        out = np.zeros(len(own) + SIDE * (len(n) + 1), np.int64)
        out[np.arange(len(own)) + SIDE * (np.repeat(np.arange(len(n)), n) + 1)] = own
        yield i, j, out


def _unpack(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for shape in _SHAPES_OF:
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape))
        at += n
    return out


def initial_parameters(table: Vocabulary) -> np.ndarray:
    """Small random numbers; the constant unit's weights are those of the tokens' counts."""
    rng = np.random.default_rng(SEED)
    parts = [rng.normal(0, 0.1, s).astype(np.float32) for s in _SHAPES_OF]
    n = table.by_token[1:].reshape(GROUPS, SLOTS) + 0.01
    parts[1][-1] = np.log(n.sum(1) / n.sum())
    parts[2][:, -1] = np.log(n / n.sum(1, keepdims=True))
    return np.concatenate([p.ravel() for p in parts])


def _hidden(p: list[np.ndarray], tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = np.zeros((len(at), WIDTH), p[0].dtype)
    for k, d in enumerate(PLACES):
        h += p[0][k].take(tokens.take(at + d), axis=0, mode="clip")
    np.tanh(h, out=h)
    h[:, -1] = 1
    return h


def _by_group(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The places in the order of their token's group, the tokens there less 1, and each group's range."""
    own = tokens[at] - 1
    order = np.argsort((own // SLOTS).astype(np.uint8), kind="stable")
    own = own[order]
    ends = np.searchsorted(own // SLOTS, np.arange(GROUPS + 1))
    return order, own, [(g, int(ends[g]), int(ends[g + 1])) for g in np.flatnonzero(np.diff(ends)).tolist()]


def _logits(p: list[np.ndarray], h: np.ndarray, groups: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of every place: for the groups, and for the tokens of its own group."""
    inner = np.empty((len(h), SLOTS), h.dtype)
    for g, a, b in groups:
        np.matmul(h[a:b], p[2][g], out=inner[a:b])
    return _safe(h @ p[1]), _safe(inner)


def _safe(z: np.ndarray) -> np.ndarray:
    """The logits, shifted only if their exponentials might not be numbers."""
    return z - z.max(1, keepdims=True) if z.max() > 80 or z.max(1).min() < -80 else z


def _row_sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], z.dtype)


def log_probabilities(p: list[np.ndarray], tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of the tokens at some places, each given those on both of its sides."""
    out = np.zeros(len(at))
    for k in range(0, len(at), BATCH):
        order, own, groups = _by_group(tokens, at[k : k + BATCH])
        h = _hidden(p, tokens, at[k : k + BATCH][order])
        rows, found = np.arange(len(own)), np.zeros(len(own))
        for z, column in zip(_logits(p, h, groups), (own // SLOTS, own % SLOTS), strict=True):
            found += z[rows, column]
            found -= np.log(_row_sums(np.exp(z, out=z)))
        out[k + order] = found
    return out


def train_step(p: list[np.ndarray], seen: list[np.ndarray], tokens: np.ndarray, at: np.ndarray) -> None:
    """One Adagrad step on some places."""
    order, own, groups = _by_group(tokens, at)
    at = at[order]
    h = _hidden(p, tokens, at)
    slopes, part = _logits(p, h, groups), np.float32(1 / len(at))
    for z, column in zip(slopes, (own // SLOTS, own % SLOTS), strict=True):  # softmax less one at the true column
        np.exp(z, out=z)
        z *= (part / _row_sums(z))[:, None]
        z[np.arange(len(at)), column] -= part
    outer, inner = slopes
    back, slope = outer @ p[1].T, np.zeros_like(p[2])
    for g, a, b in groups:
        back[a:b] += inner[a:b] @ p[2][g].T
        np.matmul(h[a:b].T, inner[a:b], out=slope[g])
    _adagrad(p[1], seen[1], h.T @ outer)
    _adagrad(p[2], seen[2], slope)
    back *= 1 - h * h  # none for the constant unit
    for k, d in enumerate(PLACES):
        near = tokens.take(at + d).astype(np.uint16)
        order = np.argsort(near, kind="stable")
        near = near[order]
        begin = np.flatnonzero(np.r_[True, near[1:] != near[:-1]])
        rows, g = near[begin], np.add.reduceat(back.take(order, axis=0), begin, axis=0)
        s = seen[0][k][rows] + g * g
        seen[0][k][rows] = s
        p[0][k][rows] -= RATE * g / (np.sqrt(s) + 1e-6)


def _adagrad(x: np.ndarray, s: np.ndarray, g: np.ndarray) -> None:
    s += g * g
    x -= RATE * g / (np.sqrt(s) + 1e-6)


def places_of_round(w: tn.Words | Places, tokens: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """The places that a round trains on: each place has its turn in one of the rounds."""
    at = np.flatnonzero(tokens)
    return at[tn.mix(w.hashes + np.uint64(977) * np.arange(len(at), dtype=np.uint64)) % np.uint64(rounds) == turn]


def in_buckets(encoded: DataFrame, buckets: int, id_col: str = "doc_id") -> DataFrame:
    """``bucket, tokens``: each bucket whole in a partition, in an order of its own.

    Copies differ in their ids, so a large group of copies is spread over the buckets.
    """
    key = F.xxhash64(id_col, "tokens")
    rows = encoded.where("n_tokens > 0").select(key.alias("key"), "tokens")
    rows = rows.select(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(buckets)).cast("int").alias("bucket"), "key", "tokens")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "key", "tokens").select("bucket", "tokens")


def train_round(rows: DataFrame, start: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Parameters after each bucket has trained on the turn's places of all its texts, averaged by places.

    A bucket is trained in pieces that end with a text, cut by the bucket's rows alone.
    """
    sent = rows.sparkSession.sparkContext.broadcast(start)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, pad = sent.value, np.zeros(SIDE, np.int64)
        bucket, held, size, n = None, [pad], 0, 0
        flat, p, seen = None, [], []

        def learn() -> int:
            nonlocal held, size
            tokens = np.concatenate(held)
            at = places_of_round(Places(tokens[tokens > 0].astype(np.uint64)), tokens, turn, rounds)
            for k in range(0, len(at), BATCH):
                train_step(p, seen, tokens, at[k : k + BATCH])
            held, size = [pad], 0
            return len(at)

        def result() -> pa.RecordBatch:
            whole = np.zeros(-(-len(flat) // CHUNK) * CHUNK, np.float32)
            whole[: len(flat)] = flat
            parts = whole.reshape(-1, CHUNK)
            columns = [np.arange(len(parts)), np.full(len(parts), bucket, np.int64), np.full(len(parts), n, np.int64)]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([x.tobytes() for x in parts], pa.binary())], names=["chunk", "bucket", "n", "part"])

        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket:
                    if bucket is not None:
                        n += learn()
                        yield result()
                    bucket, n, flat = b, 0, start.copy()
                    p, seen = _unpack(flat), [np.full(s, 1e-8, np.float32) for s in _SHAPES_OF]
                held += [np.frombuffer(raw, "<u2").astype(np.int64), pad]
                size += len(raw) // 2
                if size >= HELD:
                    n += learn()
        if bucket is not None:
            n += learn()
            yield result()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for c, n, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                held = total.setdefault(c, [0, np.zeros(CHUNK)])
                held[0] += n
                held[1] += n * np.frombuffer(raw, np.float32).astype(np.float64)
        parts = [(s / max(n, 1)).astype(np.float32).tobytes() for n, s in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(parts, pa.binary())], names=["chunk", "part"])

    trained = rows.mapInArrow(fit, "chunk bigint, bucket bigint, n bigint, part binary")
    means = trained.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(add, "chunk bigint, part binary").toPandas().sort_values("chunk")
    sent.unpersist()
    return np.frombuffer(b"".join(means["part"]), np.float32)[: len(start)].copy() if len(means) else start


def fit_network(encoded: DataFrame, table: Vocabulary, rounds: int = ROUNDS, id_col: str = "doc_id") -> np.ndarray:
    """The network's parameters, of a size fixed by the constants above."""
    flat = initial_parameters(table)
    words = table.by_token.sum()
    for turn in range(rounds if words else 0):
        flat = train_round(in_buckets(encoded, max(1, round(words / BUCKET_WORDS)), id_col), flat, turn, rounds)
    return flat


def fit_language_model(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, id_col: str = "doc_id", most_sent: int = MOST_SENT) -> tuple[Vocabulary, np.ndarray]:
    """Vocabulary, which grows with the corpus, and parameters. The same rows give the same, however they are partitioned."""
    table = vocabulary(docs, text_col, most_sent)
    encoded = stage_table(encode_documents(docs, table, id_col, text_col).select(id_col, "n_tokens", "tokens"), "lm-tokens")
    flat = fit_network(encoded, table, rounds, id_col)
    drop_table(encoded)
    return table, flat


def score_encoded(encoded: DataFrame, table: Vocabulary, flat: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_tokens, log_prob, mean_log_prob`` of encoded documents."""
    sent = encoded.sparkSession.sparkContext.broadcast(flat)
    names = [id_col, "n_tokens", "share", *["words"] * (table.table is not None), "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _unpack(sent.value)
        for batch in batches:
            for i, j, tokens in _streams(batch.column(len(names) - 1)):
                each = np.r_[0, np.cumsum(log_probabilities(p, tokens, np.flatnonzero(tokens)))]
                part = batch.slice(i, j - i)
                ends = np.r_[0, np.cumsum(part.column(1).to_numpy())]
                total = each[ends[1:]] - each[ends[:-1]] + part.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(total)], names=[*names[:-1], "log_prob"])

    rows = encoded.select(*[encoded[f"`{n}`"] for n in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", log_prob double"
    out = rows.mapInArrow(run, schema).drop("share")
    if table.table is not None:
        out = _with_joined_shares(out, table.table)
    out = out.withColumn("log_prob", F.round("log_prob", 6))
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def score_documents(docs: DataFrame, table: Vocabulary, flat: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, log_prob, mean_log_prob``: pseudo-log-likelihood of every whole text, the sum to six places.

    Null and empty texts have no tokens, log-probability 0 and a null mean. Null ids pass through, repeated rows are
    each scored, equal texts score alike, an empty table gives an empty result; further columns are dropped. Where the
    vocabulary is too large to be sent, its words' shares meet the documents' words in a join.
    """
    return score_encoded(encode_documents(docs, table, id_col, text_col), table, flat, id_col)


def _with_joined_shares(scored: DataFrame, shares: DataFrame) -> DataFrame:
    """The rows with the shares of their words in place of those of rare words."""
    rows = stage_table(scored.withColumn("_row", F.monotonically_increasing_id()), "lm-scored")
    each = rows.select("_row", F.explode("words").alias("w")).select("_row", "w.*")
    more = each.join(shares, "word").groupBy("_row").agg(F.sum(F.col("n") * (F.col("share") - F.col("rest"))).alias("_more"))
    out = rows.drop("words").join(more, "_row", "left")
    return out.withColumn("log_prob", F.col("log_prob") + F.coalesce("_more", F.lit(0.0))).drop("_row", "_more")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    table = vocabulary(docs)
    encoded = stage_table(encode_documents(docs, table), "lm-tokens")
    return score_encoded(encoded, table, fit_network(encoded, table))

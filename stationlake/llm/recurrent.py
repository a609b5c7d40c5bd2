"""A gated recurrent language model in numpy, trained and applied on all documents.

Words are white-space tokens in lower case (A-Z), then an end. The ``head``
most frequent words have their own input and output vectors; output goes
through classes: the model gives a class from its state, then a head word of
the class. All other words share classes by their first two bytes; inside such a
class a word has its share of the training counts, an unseen one half a count.
So the probabilities of all words sum to one.

Training: every task reads its share of the training documents once, in lanes,
with truncated backpropagation over ``window`` steps and the state carried on;
a document starts from the zero state. The tasks' weights are averaged by their
tokens, in turns: a first, small part of the documents, then larger ones from
the average before. Counts and training cover all training documents.

Scoring carries the state through whole documents. Counts of the ``listed`` most
frequent words go out with the model; those of rarer words are joined. What is
sent out is bounded by ``head`` and ``listed``.

Defined results: null and empty texts are one end token; rows without key are
learned from, and not held out; rows that repeat key and text are scored alike;
without training documents all counts are 0. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.llm.frames import as_bytes, extended, stored
from stationlake.llm.hashing import SPACED, Lookup, portions, word_hashes

END = 0x5DEECE66D1234567
HELD_OUT = 1


@dataclass(frozen=True)
class Shape:
    """Sizes of the model and settings of its training."""

    hidden: int = 16
    head: int = 1024
    classes: int = 24
    shared: int = 40
    inputs: int = 512
    window: int = 16
    lanes: int = 512
    rate: float = 0.08
    turns: tuple[float, ...] = (0.1, 0.3, 0.6)
    listed: int = 200_000

    @property
    def per_class(self) -> int:
        return -(-(self.head + 1) // self.classes)


def tokens(texts: list[bytes | None], at_once: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of their first two bytes, with an end after each text, and where texts start.

    Some texts at a time, as their bytes become several arrays of eight times the size.
    """
    parts = [(word_hashes(texts[a:b], SPACED, initials=True)) for a, b in portions(texts, at_once)]
    n = np.concatenate([np.diff(starts) for _, starts, _ in parts] + [np.empty(0, np.int64)])
    ends = np.cumsum(n + 1)
    size = int(ends[-1]) if len(ends) else 0
    out, first, word = np.full(size, END, np.uint64), np.zeros(size, np.uint64), np.ones(size, bool)
    word[ends - 1] = False
    if parts:
        out[word], first[word] = (np.concatenate([p[i] for p in parts]) for i in (0, 2))
    return out, first, np.concatenate(([0], ends))


def _counted(batches):
    for batch in batches:
        texts = as_bytes(batch.column(0))
        for a, b in portions(texts, 16 << 20):
            words, first, _ = tokens(texts[a:b])
            keys, at, n = np.unique(words, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(first[at].view(np.int64)), pa.array(n)], names=["word", "initial", "n"]
            )


@dataclass
class Words:
    """What is known of words: the listed ones with their counts, the first of them with places in the model."""

    listed: Lookup
    counts: np.ndarray  # of the listed words, then 0
    place: np.ndarray  # of the listed words: place among head words or -1, then -1
    total: int
    kinds: int
    class_total: np.ndarray
    class_kinds: np.ndarray


@dataclass
class Network:
    shape: Shape
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, shape: Shape, head_counts: np.ndarray, class_total: np.ndarray) -> Network:
        """Small random weights; output offsets give the training frequencies."""
        draw, h, c, k = np.random.default_rng(17), shape.hidden, shape.classes, shape.per_class
        normal = lambda *s, scale=0.1: draw.normal(scale=scale, size=s).astype(np.float32)
        counts = np.zeros(c * k)
        counts[: len(head_counts)] = head_counts
        counts = counts.reshape(k, c).T + 0.5  # words go to classes in turn, so classes are of like weight
        sums = np.concatenate((counts.sum(axis=1), class_total + 0.5))
        return cls(
            shape,
            {
                "input": normal(shape.head + 1 + shape.inputs + 1, 3 * h, scale=0.3),
                "state": normal(h, 3 * h, scale=0.3),
                "class": normal(h, c + shape.shared),
                "class0": np.log(sums / sums.sum()).astype(np.float32),
                "word": normal(c, h, k),
                "word0": np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32),
            },
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()]).astype(np.float64)

    def with_flat(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for name, w in self.weights.items():
            out[name] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        return Network(self.shape, out)

    def forward(self, inputs: np.ndarray, begins: np.ndarray, state: np.ndarray):
        """States after and before each step of (steps, lanes) inputs, and what else backpropagation needs."""
        h, steps, lanes = self.shape.hidden, *inputs.shape
        table, turn = self.weights["input"], self.weights["state"]
        out, held = np.empty((steps, lanes, h), np.float32), np.empty((steps, lanes, h), np.float32)
        # Both gates of a step lie apart, so that passes over one of them are over adjoining numbers.
        gates = np.empty((steps, 2, lanes, h), np.float32)
        fresh, mixed_in = np.empty((steps, lanes, h), np.float32), np.empty((steps, lanes, h), np.float32)
        given = table.take(inputs, axis=0)
        # In place, as these arrays are small and passes over them are what costs.
        starting = begins.any(axis=1).tolist()
        for t in range(steps):
            before = held[t] = state * ~begins[t][:, None] if starting[t] else state
            g = before @ turn
            gate, inner, new = gates[t], mixed_in[t], fresh[t]
            np.add(given[t, :, :h], g[:, :h], out=gate[0])
            np.add(given[t, :, h : 2 * h], g[:, h : 2 * h], out=gate[1])
            np.negative(gate, out=gate)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            inner[:] = g[:, 2 * h :]
            np.multiply(gate[1], inner, out=new)
            new += given[t, :, 2 * h :]
            np.tanh(new, out=new)
            state = out[t]
            np.subtract(before, new, out=state)
            state *= gate[0]
            state += new
        return out, held, gates, fresh, mixed_in

    def logs(self, states: np.ndarray, kind: np.ndarray, word: np.ndarray, shares: bool = True):
        """Natural logs of the class and, for head words, of the word; states by row, kinds and words by row.

        With ``shares`` also the probabilities that gradients need.
        """
        w, c = self.weights, self.shape.classes
        # States lie between -1 and 1: most weights cannot let an exponential overflow.
        safe = max(np.abs(w[n]).sum(axis=-2).max() + np.abs(w[f"{n}0"]).max() for n in ("class", "word")) < 80
        raw = states @ w["class"]
        raw += w["class0"]
        if not safe:
            raw -= raw.max(axis=1, keepdims=True)
        log = raw[np.arange(len(states)), kind]
        share = np.exp(raw, out=raw)
        # Sums along rows are products with ones: several times faster than reductions of short rows.
        total = share @ np.ones(share.shape[1], share.dtype)
        log -= np.log(total)
        if shares:
            share /= total[:, None]
        order = np.argsort(kind.astype(np.int16), kind="stable")
        bounds = np.searchsorted(kind[order], np.arange(c + 1))
        inner = []
        for k in range(c):
            at = order[bounds[k] : bounds[k + 1]]
            if len(at):
                x = states.take(at, axis=0) @ w["word"][k]
                x += w["word0"][k]
                if not safe:
                    x -= x.max(axis=1, keepdims=True)
                own = x[np.arange(len(at)), word[at]]
                e = np.exp(x, out=x)
                s = e @ np.ones(e.shape[1], e.dtype)
                own -= np.log(s)
                log[at] += own
                if shares:
                    e /= s[:, None]
                    inner.append((k, at, e))
        return log, share, inner

    def gradients(self, inputs, begins, state, kind, word, there):
        """Gradients of the mean negative log over the places that are there, and the state after."""
        w, h = self.weights, self.shape.hidden
        out, held, gates, fresh, mixed_in = self.forward(inputs, begins, state)
        steps, lanes = inputs.shape
        states = out.reshape(-1, h) if there is None else out.reshape(-1, h)[there]
        log, share, inner = self.logs(states, kind, word)
        n = len(states)
        share[np.arange(n), kind] -= 1
        grads = {"class": states.T @ share, "class0": np.ones(n, share.dtype) @ share, "word": np.zeros_like(w["word"]), "word0": np.zeros_like(w["word0"])}
        d = share @ w["class"].T
        for k, at, e in inner:
            e[np.arange(len(at)), word[at]] -= 1
            grads["word"][k], grads["word0"][k] = states.take(at, axis=0).T @ e, np.ones(len(at), e.dtype) @ e
            d[at] += e @ w["word"][k].T
        # The mean is taken here, of the small arrays.
        d /= n
        for g in grads.values():
            g /= n
        if there is None:
            d_states = d.reshape(steps, lanes, h)
        else:
            d_states = np.zeros((steps * lanes, h), np.float32)
            d_states[there] = d
            d_states = d_states.reshape(steps, lanes, h)
        back = np.zeros((lanes, h), np.float32)
        d_given, d_turned = np.empty((steps, lanes, 3 * h), np.float32), np.empty((steps, lanes, 3 * h), np.float32)
        turn = w["state"].T
        keep, reset = gates[:, 0], gates[:, 1]
        to_new = (1 - keep) * (1 - fresh * fresh)
        to_keep = (held - fresh) * keep * (1 - keep)
        to_reset = mixed_in * reset * (1 - reset)
        starting = begins.any(axis=1).tolist()
        for t in range(steps - 1, -1, -1):
            back += d_states[t]
            own, turned = d_given[t], d_turned[t]
            d_new = own[:, 2 * h :]
            np.multiply(back, to_new[t], out=d_new)
            np.multiply(back, to_keep[t], out=own[:, :h])
            np.multiply(d_new, to_reset[t], out=own[:, h : 2 * h])
            turned[:, : 2 * h] = own[:, : 2 * h]
            np.multiply(d_new, reset[t], out=turned[:, 2 * h :])
            back *= keep[t]
            back += turned @ turn
            if starting[t]:
                back *= ~begins[t][:, None]
        grads["state"] = held.reshape(-1, h).T @ d_turned.reshape(-1, 3 * h)
        flat = inputs.ravel()
        order = np.argsort(flat, kind="stable")
        rows, first = np.unique(flat[order], return_index=True)
        grads["input"] = (rows, np.add.reduceat(d_given.reshape(-1, 3 * h).take(order, axis=0), first))
        return grads, out[-1], float(-log.sum())


def coded(words: Words, shape: Shape, hashes: np.ndarray, initial: np.ndarray):
    """Per token: its place as an input, its class, its place in the class, its count, and whether that is known here."""
    at = words.listed.find(hashes)
    place = words.place[at]
    head = place >= 0
    given = np.where(head, place, shape.head + 1 + (hashes % np.uint64(shape.inputs)).astype(np.int64))
    kind = np.where(head, place % shape.classes, shape.classes + (initial % np.uint64(shape.shared)).astype(np.int64))
    return given, kind, np.where(head, place // shape.classes, 0), words.counts[at], at < words.listed.n


def dealt(starts: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents to lanes of like length, longest lanes first."""
    size = np.diff(starts)
    load = [(0, i) for i in range(lanes)]
    out: list[list[int]] = [[] for _ in range(lanes)]
    for d in np.argsort(-size, kind="stable").tolist():
        total, lane = heapq.heappop(load)
        out[lane].append(d)
        heapq.heappush(load, (total + int(size[d]), lane))
    return sorted((o for o in out if o), key=lambda o: -int(size[o].sum()))


def windows(starts: np.ndarray, shape: Shape, least: int = 0):
    """Windows over lanes: token places (steps, lanes), -1 where a lane has ended, and document begins.

    ``least`` makes windows longer where few lanes are left, to hold about so many places: scores do
    not depend on where windows end, and each window costs a fixed time.
    """
    n = int(starts[-1])
    lanes = dealt(starts, max(8, min(shape.lanes, n // (8 * shape.window))))
    flat = [np.concatenate([np.arange(starts[d], starts[d + 1]) for d in own]) for own in lanes]
    size = np.array([len(f) for f in flat])
    begin = np.zeros(n, bool)
    begin[starts[:-1]] = True
    longest = int(size[0]) if len(size) else 0
    # Lanes side by side, unless one long document would make this far larger than the tokens.
    side = None
    if len(flat) * longest <= 4 * n:
        side = np.full((longest, len(flat)), -1)
        for i, own in enumerate(flat):
            side[: len(own), i] = own
    at = steps = 0
    while (at := at + steps) < longest:
        live = int((size > at).sum())
        steps = min(max(shape.window, least // live), longest - at)
        if side is not None:
            places = np.ascontiguousarray(side[at : at + steps, :live])
        else:
            places = np.full((steps, live), -1)
            for i in range(live):
                own = flat[i][at : at + steps]
                places[: len(own), i] = own
        yield places, begin[places] | (places < 0)


def _trained(shared, shape: Shape):
    def run(batches):
        words, network = shared.value
        weights = {k: v.copy() for k, v in network.weights.items()}
        local = Network(shape, weights)
        sums = {k: np.full_like(v, 1e-4) for k, v in weights.items()}
        seen = 0
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for a, b in portions(texts, 8 << 20):
                hashes, initial, starts = tokens(texts[a:b])
                given, kind, word, _, _ = coded(words, shape, hashes, initial)
                before = np.concatenate(([len(weights["input"]) - 1], given[:-1]))
                before[starts[:-1]] = len(weights["input"]) - 1
                state = np.zeros((0, shape.hidden), np.float32)
                for places, begins in windows(starts, shape):
                    live = places.shape[1]
                    state = state[:live] if len(state) else np.zeros((live, shape.hidden), np.float32)
                    there = places.ravel() >= 0
                    own = places.ravel()[there]
                    x = before[places]
                    grads, state, _ = local.gradients(x, begins, state, kind[own], word[own], None if there.all() else there)
                    rows, g = grads.pop("input")
                    sums["input"][rows] += g * g
                    weights["input"][rows] -= shape.rate * g / np.sqrt(sums["input"][rows])
                    for name, g in grads.items():
                        sums[name] += g * g
                        weights[name] -= shape.rate * g / np.sqrt(sums[name])
                    seen += len(own)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([(local.flat() * seen).tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["weights", "n"])

    return run


def _summed(batches):
    total, n = None, 0
    for batch in batches:
        for data, m in zip(batch.column("weights").to_pylist(), batch.column("n").to_pylist()):
            row = np.frombuffer(data, np.float64)
            total = row.copy() if total is None else total + row
            n += m
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["weights", "n"])


def averaged(parts: DataFrame, network: Network, fan_in: int = 16) -> Network:
    """The tasks' weights, averaged by tokens; summed in levels, so the driver gets ``fan_in`` rows at most."""
    parts, n = stored(parts, "weights"), None
    while (n := parts.count()) > fan_in:
        parts = stored(parts.repartition(-(-n // fan_in)).mapInArrow(_summed, "weights binary, n long"), "weights")
    rows = parts.collect()
    if not rows:
        return network
    return network.with_flat(sum(np.frombuffer(r["weights"], np.float64) for r in rows) / sum(r["n"] for r in rows))


def _scored(shared, shape: Shape, base: float):
    def run(batches):
        words, network = shared.value
        start = len(network.weights["input"]) - 1
        room = np.log(words.class_total + 0.5 * (words.class_kinds + 1))
        for batch in batches:
            texts = as_bytes(batch.column("__text"))
            columns = [[] for _ in range(6)]
            for a, b in portions(texts, 8 << 20):
                hashes, initial, starts = tokens(texts[a:b])
                given, kind, word, count, known = coded(words, shape, hashes, initial)
                before = np.concatenate(([start], given[:-1]))
                before[starts[:-1]] = start
                log = np.zeros(len(hashes))
                state = np.zeros((0, shape.hidden), np.float32)
                for places, begins in windows(starts, shape, shape.window * shape.lanes):
                    live = places.shape[1]
                    state = state[:live] if len(state) else np.zeros((live, shape.hidden), np.float32)
                    out = network.forward(before[places], begins, state)[0]
                    state = out[-1]
                    there = places.ravel() >= 0
                    own, whole, rows = places.ravel()[there], there.all(), out.reshape(-1, shape.hidden)
                    log[own] = network.logs(rows if whole else rows[there], kind[own], word[own], shares=False)[0]
                tail = kind >= shape.classes
                log[tail] -= room[kind[tail] - shape.classes]
                counted = np.log(count + 0.5)
                log[tail & known] += counted[tail & known]
                own_base = np.where(known, counted, 0.0) - base
                add = lambda x: np.add.reduceat(x, starts[:-1]) if len(starts) > 1 else np.empty(0)
                rare = ~known
                at = np.concatenate(([0], np.cumsum(rare)))[starts]
                for column, value in zip(columns, (np.diff(starts), add(known.astype(np.int64)), add(log), add(own_base), np.diff(at), hashes[rare])):
                    column.append(value)
            n, n_known, score, own_base, n_rare, flat = (np.concatenate(c) if c else np.empty(0) for c in columns)
            ends = np.concatenate(([0], np.cumsum(n_rare))).astype(np.int32)
            yield [
                pa.array(n.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(score.astype(float)), pa.array(own_base.astype(float)),
                pa.ListArray.from_arrays(ends, pa.array(flat.astype(np.uint64).view(np.int64))),
                [xxhash.xxh3_64_intdigest(t or b"") - (1 << 63) for t in texts],
            ]

    return run


def fit(rows: DataFrame, shape: Shape) -> tuple[Words, Network, DataFrame]:
    """Counts and network of the rows with ``__text`` and ``__turn`` (0 to 1, which part of the training)."""
    spark = rows.sparkSession
    counts = stored(
        rows.select("__text").mapInArrow(_counted, "word long, initial long, n long").groupBy("word").agg(F.first("initial").alias("initial"), F.sum("n").alias("n")),
        "counts",
    )
    end = F.col("word") == F.lit(int(np.uint64(END).view(np.int64)))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("kinds")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(max(shape.listed, shape.head)).toPandas()
    ends = counts.filter(end).toPandas()
    listed = np.concatenate((ends["word"].to_numpy(np.int64), top["word"].to_numpy(np.int64)[top["word"].to_numpy(np.int64) != np.uint64(END).view(np.int64)])).view(np.uint64)
    n = np.concatenate((ends["n"].to_numpy(np.int64), top["n"].to_numpy(np.int64)[top["word"].to_numpy(np.int64) != np.uint64(END).view(np.int64)]))
    if not len(listed):
        listed, n = np.array([END], np.uint64), np.zeros(1, np.int64)
    heads = min(len(listed), shape.head)
    place = np.full(len(listed) + 1, -1)
    place[:heads] = np.arange(heads)
    # Classes of the other words: all counts less those of head words.
    head_words = spark.createDataFrame([(int(w),) for w in listed[:heads].view(np.int64)], "word long")
    others = counts.join(F.broadcast(head_words), "word", "left_anti")
    kind = _modulo("initial", shape.shared)
    found = others.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()
    class_total, class_kinds = np.zeros(shape.shared), np.zeros(shape.shared)
    for r in found:
        class_total[r["kind"]], class_kinds[r["kind"]] = r["n"], r["kinds"]
    words = Words(Lookup(listed), np.append(n, 0).astype(float), place, sums["total"], sums["kinds"], class_total, class_kinds)
    network, below = Network.start(shape, n[:heads].astype(float), class_total), 0.0
    for part in shape.turns:
        of_turn = rows.filter((F.col("__turn") >= below) & (F.col("__turn") < below + part)).select("__text")
        shared = spark.sparkContext.broadcast((words, network))
        network, below = averaged(of_turn.mapInArrow(_trained(shared, shape), "weights binary, n long"), network), below + part
    return words, network, counts


def _modulo(column: str, n: int):
    """The unsigned value of a long, modulo n."""
    return F.pmod(F.pmod(F.col(column), F.lit(n)) + F.when(F.col(column) < 0, F.lit(pow(2, 64, n))).otherwise(F.lit(0)), F.lit(n)).cast("int")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10) per row."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(key).alias("__key"), held_out.alias("held_out"), F.col(text).alias("__text"))
    turn = (F.pmod(F.xxhash64("__key"), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("__turn")
    words, network, counts = fit(rows.filter(~F.col("held_out")).select("__text", turn), shape)
    base = float(np.log(words.total + 0.5 * (words.kinds + 1)))
    shared = spark.sparkContext.broadcast((words, network))
    schema = "n_tokens long, n_known long, score double, base_score double, rare array<long>, text_key long"
    scored = stored(extended(rows, schema, _scored(shared, shape, base), keep=["__key", "held_out"]), "scored")
    # Each row leaves a mark, so rows that repeat share their sums evenly.
    marked = scored.select("__key", "text_key", F.explode(F.concat("rare", F.array(F.lit(0).cast("long")))).alias("word"), F.size("rare").alias("m")).filter("m > 0")
    pairs = marked.groupBy("__key", "text_key", "word").agg(F.count(F.lit(1)).alias("times"))
    counted = pairs.join(counts.select("word", "n"), "word", "left")
    known = F.coalesce("n", F.lit(0))
    sums = counted.groupBy("__key", "text_key").agg(
        F.max(F.when(F.col("word") == 0, F.col("times"))).alias("rows"),
        F.sum(F.when((F.col("word") != 0) & (known > 0), F.col("times"))).alias("known"),
        F.sum(F.when(F.col("word") != 0, F.col("times") * F.log(known + 0.5))).alias("log"),
    )
    sums = sums.select(F.col("__key").alias("__k"), F.col("text_key").alias("__t"), (F.col("known") / F.col("rows")).cast("long").alias("more"), (F.col("log") / F.col("rows")).alias("log"))
    whole = scored.join(sums, scored["__key"].eqNullSafe(F.col("__k")) & (scored["text_key"] == F.col("__t")), "left")
    ten = F.log(F.lit(10.0))
    return whole.select(
        F.col("__key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        ((F.col("base_score") + F.coalesce("log", F.lit(0.0))) / ten).alias("base_score"),
        ((F.col("score") + F.coalesce("log", F.lit(0.0))) / ten).alias("score"),
    )

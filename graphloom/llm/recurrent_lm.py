"""LM scoring with a gated recurrent language model in numpy.

Word counts come from all training documents by a distributed sum. The most frequent words,
as many as grow with the root of the number of distinct ones, each have an output of their
own; words are factored into classes of similar total frequency, P(w) = P(class | state)
P(w | class, state). All other training words share one more class, in which a word's
probability is its share of the counts, and a word never seen has the smoothed share that
the base gives it. The network is trained by truncated backpropagation on every training
document: learners, one for each run of input partitions, train side by side with the state
carried from window to window, and their parameters are averaged after each of a number of
rounds, which share the documents out among them. No text is moved to train. Whole
documents are scored the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language_id import held_out
from .shared import settle

#: State and embedding sizes, and words whose counts every worker holds; others are joined.
STATE, EMBED, TABLE_WORDS = 16, 16, 200_000
#: The network's words are LEAST_KNOWN, or PER_ROOT for each root of a distinct word where that is more.
LEAST_KNOWN, PER_ROOT = 2_000, 1
#: Rounds, words of a learner and of one call, and lanes of it.
ROUNDS, LEARNER_WORDS, CALL_WORDS, LANES = 2, 1_000_000, 200_000, 256
#: Rows of states that are scored together at least, so that the last long documents don't go a few words at a time.
SCORED_ROWS = 1 << 14
#: Parameters that move as one row when learners are averaged.
PART = 1 << 15
END = "\n"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BYTES = bytes.maketrans(_UPPER.encode(), _LOWER.encode())


def words_of(text: Column) -> Column:
    """The lower-cased words of a text, and an end."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + "\t\n\x0b\x0c\r", _LOWER + "     ")
    return F.concat(F.filter(F.split(spaced, " "), lambda w: w != ""), F.array(F.lit(END)))


def lowered(texts: pa.Array) -> Iterator[bytes]:
    """The lower-cased bytes of texts; their split() gives the words."""
    for text in texts.cast(pa.binary()):
        yield (text.as_py() or b"").translate(_BYTES)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Parameters: embedding, gates (update, reset, candidate), class outputs, word outputs by class slot."""

    embed: np.ndarray  # (known + 1) x EMBED; the last row is every other word
    wx: np.ndarray  # EMBED x 3 STATE
    wh: np.ndarray  # STATE x 3 STATE
    b: np.ndarray
    wc: np.ndarray  # STATE x (classes + 1); the last class is every other word
    bc: np.ndarray
    ww: np.ndarray  # classes x STATE x slots
    bw: np.ndarray  # classes x slots, -inf where a class has no word

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.wx, self.wh, self.b, self.wc, self.bc, self.ww, self.bw]

    def step(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, tuple]:
        s = h.shape[1]
        x = self.embed[w]
        gx = x @ self.wx + self.b
        gh = h @ self.wh
        z, r = sigmoid(gx[:, :s] + gh[:, :s]), sigmoid(gx[:, s : 2 * s] + gh[:, s : 2 * s])
        c = np.tanh(gx[:, 2 * s :] + r * gh[:, 2 * s :])
        return (1 - z) * h + z * c, (x, h, z, r, c, gh[:, 2 * s :])


def classes_of(counts: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class and slot of each known word, given in falling order of count: classes of near-equal sums of square roots of counts."""
    if not len(counts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mass = np.cumsum(np.sqrt(counts))
    cls = np.unique(np.minimum((mass - 1e-9) / mass[-1] * classes, classes - 1).astype(np.int64), return_inverse=True)[1]
    first = np.searchsorted(cls, np.arange(classes))
    return cls, np.arange(len(cls)) - first[cls]


def new_network(counts: np.ndarray, others: float, cls: np.ndarray, slot: np.ndarray, classes: int, seed: int = 3) -> Network:
    """Small random weights; output biases start at the unigram model."""
    r = np.random.default_rng(seed)
    slots = int(slot.max(initial=0)) + 1
    rnd = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
    bw = np.full((classes, slots), -1e9, np.float32)
    bw[cls, slot] = np.log(counts + 0.5)
    mass = np.bincount(cls, counts + 0.5, classes) if len(cls) else np.zeros(classes)
    bc = np.log(np.append(mass, others + 0.5) + 1e-9).astype(np.float32)
    return Network(rnd(len(counts) + 1, EMBED), rnd(EMBED, 3 * STATE), rnd(STATE, 3 * STATE), np.zeros(3 * STATE, np.float32), rnd(STATE, classes + 1) * 0.1, bc - bc.max(), rnd(classes, STATE, slots) * 0.1, bw)


def _logits(s: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Outputs (outputs x rows) less each row's largest. The rows lie along the last axis, where a sum over few outputs is a sum of long vectors."""
    a = w.T @ s.T
    a += b[:, None]
    a -= a.max(0)
    return a


def _slopes(s: np.ndarray, w: np.ndarray, b: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the outputs' weights and biases and of the rows, where each row is to give its pick."""
    a = _logits(s, w, b)
    np.exp(a, out=a)
    a /= a.sum(0)
    a[pick, np.arange(len(pick))] -= 1
    return (a @ s).T, a.sum(1), (w @ a).T


def _picked(s: np.ndarray, w: np.ndarray, b: np.ndarray, pick: np.ndarray, most: int = 4096) -> np.ndarray:
    """Log-probability of each row's pick, `most` rows at a time, so that they stay near the processor."""
    out = np.empty(len(s), np.float32)
    for lo in range(0, len(s), most):
        a = _logits(s[lo : lo + most], w, b)
        some = pick[lo : lo + most]
        own = a[some, np.arange(len(some))]
        np.exp(a, out=a)
        out[lo : lo + most] = own - np.log(a.sum(0))
    return out


def _by_class(yc: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """These rows in order of their class, and (class, begin, end) of each class among them."""
    rows = rows[np.argsort(yc[rows], kind="stable")]
    of = yc[rows]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return rows, list(zip(of[first].tolist(), first.tolist(), [*first[1:].tolist(), len(rows)], strict=True))


@dataclass
class Adam:
    """Moments of the gradients, which go on from call to call."""

    m: list[np.ndarray]
    v: list[np.ndarray]
    t: int = 0


def train(net: Network, streams: np.ndarray, cls: np.ndarray, slot: np.ndarray, end: int, window: int = 16, rate: float = 0.02, state: Adam | None = None) -> Network:
    """Truncated backpropagation over parallel streams (lanes x length); the recurrent state goes on from window to window. Adam.

    `end` is the id behind which a document begins from a fresh state; no other id may stand for it.
    """
    known, s = len(cls), STATE
    held = np.bincount(cls, minlength=len(net.bw)).tolist()  # slots behind a class's words stand for nothing
    lanes, length = streams.shape
    state = state or Adam([np.zeros_like(p) for p in net.parts], [np.zeros_like(p) for p in net.parts])
    spare = [np.empty_like(p) for p in net.parts]
    h = np.zeros((lanes, s), np.float32)
    for at in range(0, length - 1, window):
        steps = min(window, length - 1 - at)
        x, y = streams[:, at : at + steps].T, streams[:, at + 1 : at + steps + 1].T.ravel()
        fresh = (x != end).astype(np.float32)[:, :, None]  # an end begins a document from a fresh state
        e = net.embed[x]
        gx = e @ net.wx + net.b
        before, after, gates = np.empty((steps, lanes, s), np.float32), np.empty((steps, lanes, s), np.float32), []
        for k in range(steps):
            before[k] = h = h * fresh[k]
            gh = h @ net.wh
            zr = sigmoid(gx[k, :, : 2 * s] + gh[:, : 2 * s])
            z, r = zr[:, :s], zr[:, s:]
            c = np.tanh(gx[k, :, 2 * s :] + r * gh[:, 2 * s :])
            after[k] = h = h + z * (c - h)
            gates.append((z, r, c, gh[:, 2 * s :]))
        # the outputs of all steps together
        out = after.reshape(-1, s)
        inside = y < known
        yc = np.where(inside, cls[np.minimum(y, known - 1)] if known else 0, len(net.bc) - 1)
        gwc, gbc, dout = _slopes(out, net.wc, net.bc, yc)
        dout = np.ascontiguousarray(dout)
        gww, gbw = np.zeros_like(net.ww), np.zeros_like(net.bw)
        order, parts = _by_class(yc, np.flatnonzero(inside))
        own, picks, more = out[order], slot[y[order]], np.empty((len(order), s), np.float32)
        for c, lo, hi in parts:
            n = held[c]
            gww[c, :, :n], gbw[c, :n], more[lo:hi] = _slopes(own[lo:hi], net.ww[c, :, :n], net.bw[c, :n], picks[lo:hi])
        dout[order] += more
        dout = dout.reshape(steps, lanes, s)
        back = np.zeros_like(h)
        dg, dgh = np.empty((steps, lanes, 3 * s), np.float32), np.empty((steps, lanes, 3 * s), np.float32)
        for k in range(steps - 1, -1, -1):
            z, r, c, ghc = gates[k]
            d = dout[k] + back
            dz, dcand = d * (c - before[k]) * z * (1 - z), d * z * (1 - c * c)
            dg[k, :, :s], dg[k, :, s : 2 * s], dg[k, :, 2 * s :] = dz, dcand * ghc * r * (1 - r), dcand
            dgh[k] = dg[k]
            dgh[k, :, 2 * s :] *= r
            back = (d * (1 - z) + dgh[k] @ net.wh.T) * fresh[k]
        dg, dgh = dg.reshape(-1, 3 * s), dgh.reshape(-1, 3 * s)
        ge = np.zeros_like(net.embed)
        flat_x = x.ravel()
        order = np.argsort(flat_x, kind="stable")
        first = np.flatnonzero(np.diff(flat_x[order], prepend=-1))
        ge[flat_x[order[first]]] = np.add.reduceat((dg @ net.wx.T)[order], first)
        grads = [ge, e.reshape(-1, EMBED).T @ dg, before.reshape(-1, s).T @ dgh, dg.sum(0), gwc, gbc, gww, gbw]
        state.t += 1
        t = state.t
        speed = rate * min(1.0, t / 20) * (0.1 + 0.9 * (1 - at / length))
        for p, g, a, b, x in zip(net.parts, grads, state.m, state.v, spare, strict=True):
            g /= np.float32(lanes * steps)
            np.clip(g, -0.05, 0.05, out=g)
            np.subtract(g, a, out=x)
            x *= np.float32(0.1)
            a += x
            g *= g
            g -= b
            g *= np.float32(0.01)
            b += g
            np.multiply(b, np.float32(1 / (1 - 0.99**t)), out=x)
            np.sqrt(x, out=x)
            x += np.float32(1e-6)
            np.multiply(a, np.float32(speed / (1 - 0.9**t)), out=g)
            g /= x
            p -= g
    return net


def score_documents(net: Network, cls: np.ndarray, slot: np.ndarray, docs: list[np.ndarray], end: int, lanes: int = 4096) -> np.ndarray:
    """Natural log-likelihood that the network gives each document's ids; ids >= known stand for the class of all others.

    Documents run side by side in lanes; a lane that ends takes the next document from a fresh state, so a
    document of any length is scored whole and memory stays the same.
    """
    known, n = len(cls), STATE
    held = np.bincount(cls, minlength=len(net.bw)).tolist()
    gates = net.embed @ net.wx + net.b  # of every word: there are fewer words than tokens
    out = np.zeros(len(docs))
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    for at in range(0, len(order), lanes):
        group = order[at : at + lanes]
        sizes = np.array([len(docs[i]) for i in group])
        h = np.zeros((len(group), STATE), np.float32)
        prev = np.full(len(group), end, np.int64)
        total = np.zeros(len(group))
        begin = 0
        while begin < int(sizes.max(initial=0)):
            live = int((sizes > begin).sum())
            width = min(max(32, SCORED_ROWS // live), int(sizes[0]) - begin)
            block = np.full((live, width), -1, np.int64)
            for j in range(live):
                part = docs[group[j]][begin : begin + width]
                block[j, : len(part)] = part
            begin += width
            given = np.where(block.T >= 0, np.minimum(block.T, known), known)
            states = np.empty((width, live, n), np.float32)
            h, prev = h[:live], prev[:live]
            for k in range(width):
                gx, gh = gates[prev], h @ net.wh
                zr = sigmoid(gx[:, : 2 * n] + gh[:, : 2 * n])
                c = np.tanh(gx[:, 2 * n :] + zr[:, n:] * gh[:, 2 * n :])
                states[k] = h = h + zr[:, :n] * (c - h)
                prev = given[k]
            y = block.T.ravel()
            real = np.flatnonzero(y >= 0)
            s, y = states.reshape(-1, n)[real], y[real]
            lane = real % live
            yc = np.where(y < known, cls[np.minimum(y, known - 1)] if known else 0, len(net.bc) - 1)
            got = _picked(s, net.wc, net.bc, yc)
            rows, parts = _by_class(yc, np.flatnonzero(y < known))
            s, picks, more = s[rows], slot[y[rows]], np.empty(len(rows), np.float32)
            for c, lo, hi in parts:
                more[lo:hi] = _picked(s[lo:hi], net.ww[c, :, : held[c]], net.bw[c, : held[c]], picks[lo:hi])
            got[rows] += more
            total[:live] += np.bincount(lane, got, live)
        out[group] = total
    return out


def flat(net: Network) -> np.ndarray:
    return np.concatenate([p.ravel() for p in net.parts])


def unflat(net: Network, values: np.ndarray) -> Network:
    """A network of the same shapes with these parameters."""
    cuts = np.cumsum([p.size for p in net.parts])[:-1]
    return Network(*(v.reshape(p.shape).astype(np.float32) for v, p in zip(np.split(values, cuts), net.parts, strict=True)))


def learn(net: Network, texts: Iterator[bytes] | Iterator[str], words: dict, cls: np.ndarray, slot: np.ndarray, rate: float, call: int = CALL_WORDS) -> int:
    """Train `net` on lower-cased texts one after the other, `call` words at a time; how many words it learned from. A text of any length is cut among calls."""
    known, end = len(cls), words[END]
    state = Adam([np.zeros_like(p) for p in net.parts], [np.zeros_like(p) for p in net.parts])
    held: list[np.ndarray] = []
    size = total = 0

    def go() -> None:
        stream = np.concatenate(held)
        lanes = min(LANES, max(1, len(stream) // 640))
        train(net, stream[: len(stream) // lanes * lanes].reshape(lanes, -1), cls, slot, end, rate=rate, state=state)
        held.clear()

    for text in texts:
        tokens = text.split()
        for a in range(0, len(tokens) or 1, call):
            some = tokens[a : a + call]
            ids = np.fromiter(map(words.get, some, repeat(known)), np.int64, len(some))
            if a + call >= len(tokens):
                ids = np.append(ids, end)
            held.append(ids)
            size += len(ids)
            if size >= call:
                go()
                total, size = total + size, 0
    if size >= 64:
        go()
        total += size
    return total


def _learner(shared, rate: float):
    """Each partition's network after its texts, in parts, weighed by its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, cls, slot, words = shared.value
        net = unflat(net, flat(net))
        n = learn(net, (t for batch in batches for t in lowered(batch.column("text"))), words, cls, slot, rate)
        if n:
            values = flat(net).astype(np.float64) * n
            cuts = range(0, len(values), PART)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([float(n)] * len(cuts)), pa.array([values[a : a + PART].tobytes() for a in cuts], pa.binary())], names=["part", "weight", "sums"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for part, weight, values in zip(batch.column("part").to_pylist(), batch.column("weight").to_pylist(), batch.column("sums"), strict=True):
            x = np.frombuffer(values.as_buffer())
            if part in sums:
                sums[part][0] += weight
                sums[part][1] += x
            else:
                sums[part] = [weight, x.copy()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([w for w, _ in sums.values()], pa.float64()), pa.array([x.tobytes() for _, x in sums.values()], pa.binary())], names=["part", "weight", "sums"])


_PARTS = "part int, weight double, sums binary"


def trained(net: Network, texts: DataFrame, n_words: int, words: dict[str, int], cls: np.ndarray, slot: np.ndarray, rounds: int = ROUNDS, learner_words: int = LEARNER_WORDS) -> Network:
    """The network after `rounds` rounds of learners over (turn, text), their parameters averaged by their words after each.

    A document is learned in the round that its `turn`, a hash, names. Learners are the input's
    partitions, or runs of them where these are small; their sums meet in two steps, so no task
    takes all of them, and the driver receives one network.
    """
    context = texts.sparkSession.sparkContext
    learners = max(1, round(n_words / learner_words))
    for k in range(rounds):
        shared = context.broadcast((net, cls, slot, words))
        sums = texts.where(F.pmod("turn", F.lit(rounds)) == k).coalesce(learners).select("text").mapInArrow(_learner(shared, 0.02 / 2**k), _PARTS)
        fan = max(1, math.isqrt(learners))
        sums = sums.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(fan))).repartition(fan * 4, "part", "salt").drop("salt").mapInArrow(_summed, _PARTS)
        got = sums.repartition(4, "part").mapInArrow(_summed, _PARTS).orderBy("part").toArrow()
        shared.unpersist()
        if got.num_rows:
            net = unflat(net, np.concatenate([np.frombuffer(x) / w for x, w in zip(got["sums"].to_pylist(), got["weight"].to_pylist(), strict=True)]))
    return net


#: Steps of a power of two in which counts are told apart when the most frequent words are cut off.
_FINE = 8


def most_frequent(counts: DataFrame, most: int) -> pa.Table:
    """About the `most` most frequent words (word, count), falling, the end token always among them.

    Where words of about the same count can't all be taken, a hash decides. What is summed is
    one row for each eighth of a power of two, so the words never meet in one task.
    """
    bucket = F.floor(F.log2("count") * _FINE).cast("int")
    sizes = sorted(((r["bucket"], r["count"]) for r in counts.groupBy(bucket.alias("bucket")).count().collect()), reverse=True)
    edge, share, left = -1, 0.0, most
    for at, n in sizes:
        if n > left:
            edge, share = at, left / n
            break
        left -= n
    lucky = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share * (1 << 20)
    some = counts.where((bucket > edge) | ((bucket == edge) & lucky) | (F.col("word") == END)).select("word", "count").toArrow()
    return some.sort_by([("count", "descending"), ("word", "ascending")])


def _scored(shared, group: int = 4096):
    """Per document the sums that need no table, and the words that are not among the `words`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, cls, slot, words, counts = shared.value
        known, here, get = len(cls), len(words), words.get
        logs = np.append(np.log10(counts + 0.5), 0.0)
        for batch in batches:
            texts = lowered(batch.column("text"))
            for lo in range(0, batch.num_rows, group):
                docs, sums, rare, sizes, others, seen = [], [], [], [], [], []
                for text in islice(texts, group):
                    tokens = text.split()
                    at = np.fromiter(map(get, tokens, repeat(here)), np.int32, len(tokens))
                    far = np.flatnonzero(at == here)
                    at = np.append(at, get(END, here))
                    docs.append(np.minimum(at, known))
                    sums.append(float(logs[at].sum()))
                    others.append((float(logs[at[at >= known]].sum()), int((at >= known).sum())))
                    rare.append([tokens[j].decode() for j in far])
                    sizes.append(len(at))
                    seen.append(len(tokens) - len(far) + (END in words))
                model = score_documents(net, cls, slot, docs, words.get(END, known), group)
                columns = [pa.array(model / math.log(10)), pa.array(sums), pa.array([x for x, _ in others]), pa.array([n for _, n in others], pa.int64()), pa.array(sizes, pa.int64()), pa.array(seen, pa.int64()), pa.array(rare, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, len(docs)), batch.column("doc_id").slice(lo, len(docs)), *columns], names=["row", "doc_id", "network", "logs", "other_logs", "n_other", "n_tokens", "n_seen", "rare"])

    return run


_SUMS = "row long, doc_id long, network double, logs double, other_logs double, n_other long, n_tokens long, n_seen long, rare array<string>"


def language_model_scores(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", least_known: int = LEAST_KNOWN, table_words: int = TABLE_WORDS, learner_words: int = LEARNER_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    train_on says which documents to learn from. Null texts count as empty: one end token.
    Repeated rows are documents of their own. With nothing to learn from, N and V are 0 and
    every token is unknown. Other columns are not read; an empty table gives no rows.

    Counts of all words of the training documents are summed by word. About the `table_words`
    most frequent, the end token always among them, go to every worker, a table of fixed size;
    counts of all other words are joined. The network learns from all training documents.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), train_on.alias("learn"), F.col(text_col).alias("text"))
    words = rows.where("learn").select(F.explode(words_of(F.col("text"))).alias("word"))
    counts = settle(words.groupBy("word").count(), "words")
    n, v = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    best = most_frequent(counts, max(1, table_words))
    # the end token has an output of its own, however rare it is
    names = best["word"].to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i] != END)
    table = {END if names[i] == END else names[i].encode(): k for k, i in enumerate(order)}
    c = best["count"].to_numpy().astype(np.float64)[order]
    top = c[: max(least_known, PER_ROOT * math.isqrt(int(v)))]
    classes = max(40, math.isqrt(len(top)))
    cls, slot = classes_of(top, classes)
    rest = float(n - top.sum()) + 0.5 * (v - len(top)) + 0.5
    net = new_network(top, rest, cls, slot, classes)
    if n:
        lessons = rows.where("learn").select(F.xxhash64("doc_id", "text").alias("turn"), "text")
        net = trained(net, lessons, int(n), {w: i for w, i in table.items() if i < len(top)}, cls, slot, learner_words=learner_words)
    shared = docs.sparkSession.sparkContext.broadcast((net, cls, slot, table, c))
    sums = settle(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(_scored(shared), _SUMS), "sums")
    rare = sums.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    rare = rare.join(counts, "word", "left").withColumn("log", F.log10(F.coalesce("count", F.lit(0)) + F.lit(0.5)) * F.col("times"))
    rare = rare.groupBy("row").agg(F.sum("log").alias("rare_logs"), F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    out = sums.drop("rare").join(rare, "row", "left").na.fill({"rare_logs": 0.0, "rare_known": 0})
    base = F.col("logs") + F.col("rare_logs") - F.col("n_tokens") * F.lit(math.log10(n + 0.5 * (v + 1)))
    score = F.col("network") + F.col("other_logs") + F.col("rare_logs") - F.col("n_other") * F.lit(math.log10(rest))
    return out.select("doc_id", "n_tokens", (F.col("n_seen") + F.col("rare_known")).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def model_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: learned from documents outside fold 1 of 5."""
    found = language_model_scores(docs, ~held_out("doc_id", 5, 1))
    return found.withColumn("held_out", held_out("doc_id", 5, 1)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""Operator 8, language-model scores.

Tokens are lower-cased words and one end for each document. A gated recurrent network reads the words so
far; its output is factored into the next word's class and the word within the class. The TOP most frequent
words of the training documents are binned by frequency into classes of about equal mass; for them both
factors are softmaxes on the state, and each has its own input weights. All other words are in classes by
their form; the class comes from the state, the word has its share of the class's training tokens (a softmax
over some hundred thousand rare words for each token would cost more than all else). All biases
start from the counts, so that the untrained network gives about the base score. A document is read whole:
the state is carried from window to window until its end, so that the score is the log-probability of the
complete text.

1. Documents are dealt to shards by id and text, as many as the size of all texts asks for, whatever the
   number of partitions. Each shard's tokens are written once to the checkpoint folder.
2. Counts go to buckets by word, which return each word's count over all shards and name the most frequent.
3. In each of ROUNDS rounds every shard trains from common weights by truncated backpropagation in numpy, on
   its own part for the round of all its training tokens, and the weights are averaged by tokens, 64 at a time.
4. Each shard scores its documents.

Counts and training cover all training documents. For training these stand one after another, cut into
equal stretches side by side, whatever the lengths of the texts; a stretch that starts inside a document
starts from an empty state. Rows: null text is empty and has its end only; each row gives a row; a null doc_id is
null in the result and trains; extra columns are ignored; an empty table gives no rows. A task holds
a shard, at most about SHARD_BYTES of text and more only where a single text is longer; the driver holds the network.
Shards and buckets exchange a row each way at most, and no more rows than a shard has distinct words.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, lower_ascii, mix, pack, span_hashes, table, unpack, words
from .shards import NO_ID, as_table, opened, rows_of, shard_count, sharded

FOLDS = 10
SHORT, LONG, ODD = 15, 24, b"#$%&*!|<>"
FORMS = 1 + SHORT + LONG + len(ODD)
#: Words with own weights, and their classes.
TOP, TOP_CLASSES = 1024, 24
CLASSES = TOP_CLASSES + FORMS
STATE = 16
WINDOW, SCORED = 32, 128  # steps read at a time
ROUNDS = 2
#: Bytes of a shard; of less text than SHARDS of them a shard has less, but SMALL_BYTES.
SHARD_BYTES, SHARDS, SMALL_BYTES = 12 << 20, 24, 1 << 20
#: A shard of fewer windows than FULL is read twice or more often, until LEAST_UPDATES in a round.
LEAST_UPDATES, FULL = 30, 150
LEAST_LANES, MOST_LANES = 16, 256
MERGED = 64
RATE = 0.02
END = np.uint64(0)
SMOOTH = 0.1


def held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([i != NO_ID and zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids.tolist()], bool)


def forms(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The form of each word: of short ones by hash, of longer ones by the first three bytes, or the mark at the end."""
    n = stops - starts
    head = np.zeros(len(starts), np.uint64)
    for k in range(3):
        head = head * np.uint64(257) + np.where(n > k, data[np.minimum(starts + k, len(data) - 1)], 0).astype(np.uint64)
    out = np.where(n <= 4, 1 + (h % np.uint64(SHORT)).astype(np.int64), 1 + SHORT + (mix(head) % np.uint64(LONG)).astype(np.int64))
    last = data[stops - 1] if len(stops) else data[:0]
    for k, c in enumerate(ODD):
        out[(last == c) & (n > 1)] = 1 + SHORT + LONG + k
    return out.astype(np.uint8)


class Text:
    """A shard's documents as tokens: for each token its word, a place in `names`; documents one after another."""

    FIELDS = (("ids", np.int64), ("bounds", np.int64), ("names", np.uint64), ("forms", np.uint8), ("word", np.uint32))

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, names: np.ndarray, forms: np.ndarray, word: np.ndarray):
        self.ids, self.bounds, self.names, self.forms, self.word = ids, bounds, names, forms, word
        self.out = held_out(ids)

    @classmethod
    def read(cls, rows: pa.Table) -> Text:
        ids, data, ends = opened(rows)
        data = lower_ascii(data)
        starts, stops, bounds = words(data, ends)
        h = span_hashes(data, starts, stops)
        h[h == END] += np.uint64(1)
        n, docs = len(starts), len(ids)
        doc = np.searchsorted(bounds, np.arange(n), side="right") - 1
        every, form = np.zeros(n + docs, np.uint64), np.zeros(n + docs, np.uint8)
        at = np.arange(n) + doc
        every[at], form[at] = h, forms(data, starts, stops, h) if n else 0
        names, first, word = np.unique(every, return_index=True, return_inverse=True)
        return cls(ids, bounds + np.arange(docs + 1), names, form[first], word.astype(np.uint32))

    def packed(self) -> list[bytes]:
        return [pack(getattr(self, k).astype(t)) for k, t in self.FIELDS]

    @classmethod
    def unpacked(cls, row: dict) -> Text:
        return cls(*(unpack(row[k], t) for k, t in cls.FIELDS))

    def train(self) -> np.ndarray:
        """For each token whether it is in a training document."""
        return np.repeat(~self.out, np.diff(self.bounds))

    def counts(self) -> np.ndarray:
        return np.bincount(self.word[self.train()], minlength=len(self.names))


@dataclass
class Vocabulary:
    """The most frequent words, by class, and counts of the training tokens."""

    names: np.ndarray  # in order of class
    counts: np.ndarray
    cuts: np.ndarray  # of the classes in names
    tokens: np.ndarray  # of each form, without these words
    distinct: np.ndarray

    def __post_init__(self):
        self.order = np.argsort(self.names)
        self.total = int(self.counts.sum() + self.tokens.sum())
        self.words = int((self.counts > 0).sum() + self.distinct.sum())
        n = np.diff(self.cuts)
        mass = np.add.reduceat(np.append(self.counts, 0), np.minimum(self.cuts[:-1], len(self.counts))) * (n > 0)
        mass = np.concatenate([mass + SMOOTH * n, self.tokens + SMOOTH * (self.distinct + 1)])
        self.prior = np.log(np.maximum(mass, 1e-9) / mass.sum()).astype(np.float32)
        own = np.repeat(mass[: len(n)], n)
        self.inner = np.log((self.counts + SMOOTH) / own).astype(np.float32)

    @classmethod
    def build(cls, top: list[tuple[int, int, int]], tokens: np.ndarray, distinct: np.ndarray) -> Vocabulary:
        """top: (name, count, form) by falling count; tokens and distinct words of each form, these included."""
        names, counts, form = (np.array([r[k] for r in top], np.int64) for k in range(3))
        tokens, distinct = tokens - np.bincount(form, counts, FORMS).astype(np.int64), distinct - np.bincount(form[counts > 0], minlength=FORMS)
        before = np.cumsum(counts) - counts
        bin_ = np.minimum((before * TOP_CLASSES) // max(1, int(counts.sum())), TOP_CLASSES - 1) if len(counts) else counts
        return cls(names.view(np.uint64), counts, np.searchsorted(bin_, np.arange(TOP_CLASSES + 1)), tokens, distinct)

    def find(self, names: np.ndarray) -> np.ndarray:
        """Each name's place, or -1."""
        if not len(self.names):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.names, names, sorter=self.order), len(self.names) - 1)
        at = self.order[at]
        return np.where(self.names[at] == names, at, -1)

    def inputs(self, text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each of the text's distinct words its input, class and place among the frequent words (-1: none)."""
        place, form = self.find(text.names), text.forms.astype(np.int64)
        kind = np.where(place >= 0, np.searchsorted(self.cuts, place, side="right") - 1, TOP_CLASSES + form)
        return np.where(place >= 0, place, TOP + form).astype(np.int32), kind.astype(np.int16), place.astype(np.int32)


def start_weights(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    zero = lambda *shape: np.zeros(shape, np.float32)
    return {"E": draw(TOP + FORMS, 3 * STATE), "U": draw(STATE, 3 * STATE), "W": zero(STATE, CLASSES), "b": zero(CLASSES), "V": zero(TOP, STATE), "c": zero(TOP)}


def flatten(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in "EUWbVc"])


def unflatten(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, x in start_weights().items():
        out[k] = v[at : at + x.size].reshape(x.shape).astype(np.float32)
        at += x.size
    return out


def lanes(bounds: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents dealt to n lanes, longest first, each to the shortest lane: token place by (step, lane), -1 after a
    lane's end, and whether a document starts there."""
    size = bounds[docs + 1] - bounds[docs]
    order = np.argsort(-size, kind="stable")
    fill, lane, begin = np.zeros(n, np.int64), np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    for k in order:
        lane[k] = j = int(fill.argmin())
        begin[k] = fill[j]
        fill[j] += size[k]
    place, first = np.full((int(fill.max(initial=0)), n), -1, np.int64), np.zeros((int(fill.max(initial=0)), n), bool)
    which = np.repeat(np.arange(len(docs)), size)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    place[begin[which] + inner, lane[which]] = bounds[docs[which]] + inner
    first[begin[size > 0], lane[size > 0]] = True
    return place, first


def forward(w: dict, h: np.ndarray, seen: np.ndarray, first: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """States after each step of a window; seen: the input before each token. What keep holds is filled for the way back."""
    s, kind = STATE, w["U"].dtype
    e, new = w["E"][seen], ~first[:, :, None]
    states = np.empty((*seen.shape, s), kind)
    lanes = seen.shape[1]
    g, zr, n = np.empty((lanes, 3 * s), kind), np.empty((lanes, 2 * s), kind), np.empty((lanes, s), kind)
    h = h.astype(kind)
    for t in range(len(seen)):
        h = h * new[t]
        np.matmul(h, w["U"], out=g)
        np.add(e[t, :, : 2 * s], g[:, : 2 * s], out=zr)
        np.tanh(np.multiply(zr, kind.type(0.5), out=zr), out=zr)  # the logistic function is 1/2 + 1/2 tanh(x/2)
        zr *= kind.type(0.5)
        zr += kind.type(0.5)
        z, r = zr[:, :s], zr[:, s:]
        np.multiply(r, g[:, 2 * s :], out=n)
        n += e[t, :, 2 * s :]
        np.tanh(n, out=n)
        if keep is not None:
            keep["before"][t], keep["zr"][t], keep["n"][t], keep["gn"][t] = h, zr, n, g[:, 2 * s :]
        out = states[t]
        np.subtract(h, n, out=out)
        out *= z
        out += n
        h = out
    return states


def _softmax(x: np.ndarray, own: np.ndarray, shares: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Each row's log-probability of its own column, and (if wanted) all probabilities, in x's place."""
    top = x.max() if x.size else np.float32(0)
    x -= top if x.size and top - x.min() < 60 else x.max(axis=1, keepdims=True)  # one shift for all rows where exp() allows it
    said = x[np.arange(len(x)), own]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    if shares:
        x /= total[:, None]
    return said - np.log(total), x


def _by_class(known: Vocabulary, kind: np.ndarray):
    """Class, first and last word, and rows, of each class of several words that rows have."""
    order = np.argsort(kind, kind="stable")
    cut = np.searchsorted(kind[order], np.arange(TOP_CLASSES + 1))
    for c in range(TOP_CLASSES):
        a, b = int(known.cuts[c]), int(known.cuts[c + 1])
        if b - a > 1 and cut[c + 1] > cut[c]:
            yield a, b, order[cut[c] : cut[c + 1]]


def log_probabilities(w: dict, known: Vocabulary, states: np.ndarray, kind: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Natural logarithms of each token's class given its state and, for frequent words, of the word within the class."""
    out, _ = _softmax(states @ w["W"] + (w["b"] + known.prior), kind, False)
    for a, b, own in _by_class(known, kind):
        out[own] += _softmax(states[own] @ w["V"][a:b].T + (w["c"][a:b] + known.inner[a:b]), place[own] - a, False)[0]
    return out


def gradients(w: dict, known: Vocabulary, h: np.ndarray, seen: np.ndarray, kind: np.ndarray, place: np.ndarray, first: np.ndarray, valid: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Of the mean loss of a window, going back to its start only; the last states; and the loss."""
    s, float_ = STATE, w["U"].dtype
    keep = {k: np.empty((*seen.shape, m * s), float_) for k, m in (("before", 1), ("zr", 2), ("n", 1), ("gn", 1))}
    states = forward(w, h, seen, first, keep)
    flat = states.reshape(-1, s)
    kind, place = kind.ravel(), place.ravel()
    share = (valid.ravel() / max(1, valid.sum())).astype(float_)
    said, d = _softmax(flat @ w["W"] + (w["b"] + known.prior), kind)
    d[np.arange(len(d)), kind] -= 1
    d *= share[:, None]
    out = {"E": np.zeros_like(w["E"]), "U": np.zeros_like(w["U"]), "W": flat.T @ d, "b": d.sum(axis=0), "V": np.zeros_like(w["V"]), "c": np.zeros_like(w["c"])}
    up = d @ w["W"].T
    for a, b, own in _by_class(known, kind):
        here, e = _softmax(flat[own] @ w["V"][a:b].T + (w["c"][a:b] + known.inner[a:b]), place[own] - a)
        said[own] += here
        e[np.arange(len(e)), place[own] - a] -= 1
        e *= share[own][:, None]
        out["V"][a:b], out["c"][a:b] = e.T @ flat[own], e.sum(axis=0)
        up[own] += e @ w["V"][a:b]
    up = up.reshape(states.shape)
    z, r, n = keep["zr"][:, :, :s], keep["zr"][:, :, s:], keep["n"]
    to_n, to_z, to_r = (1 - z) * (1 - n * n), (keep["before"] - n) * z * (1 - z), keep["gn"] * r * (1 - r)
    new, back = ~first[:, :, None], np.zeros_like(states[0])
    de, dg = np.empty((*seen.shape, 3 * s), float_), np.empty((*seen.shape, 3 * s), float_)
    for t in range(len(seen) - 1, -1, -1):
        dh = np.add(up[t], back, out=back)
        d, dn = dg[t], de[t, :, 2 * s :]
        np.multiply(dh, to_n[t], out=dn)
        np.multiply(dh, to_z[t], out=d[:, :s])
        np.multiply(dn, to_r[t], out=d[:, s : 2 * s])
        np.multiply(dn, r[t], out=d[:, 2 * s :])
        back = dh * z[t]
        back += d @ w["U"].T
        back *= new[t]
    de[:, :, : 2 * s] = dg[:, :, : 2 * s]
    out["U"] = keep["before"].reshape(-1, s).T @ dg.reshape(-1, 3 * s)
    order = np.argsort(seen.ravel(), kind="stable")
    inputs, begin = np.unique(seen.ravel()[order], return_index=True)
    out["E"][inputs] = np.add.reduceat(de.reshape(-1, 3 * s)[order], begin, axis=0)
    return out, states[-1], -float((said * share).sum())


def stretches(text: Text, n: int, *values: np.ndarray) -> list[np.ndarray]:
    """first, valid and the tokens' values, by (step, lane), of all tokens of the training documents, these in a mixed order;
    the first value is that of the token before (0 at a document's start, where no state is carried)."""
    docs = np.flatnonzero(~text.out)
    docs = docs[np.argsort(mix(docs.astype(np.uint64)), kind="stable")]
    cuts = [slice(text.bounds[k], text.bounds[k + 1]) for k in docs]
    word = np.concatenate([text.word[c] for c in cuts])
    first = np.zeros(len(word), bool)
    first[np.cumsum([0, *(c.stop - c.start for c in cuts[:-1])])] = True  # every document has a token
    rows = [first, np.ones(len(word), bool), np.where(first, values[0][0], np.roll(values[0][word], 1)), *(v[word] for v in values[1:])]
    pad = -len(word) % n
    return [np.pad(x, (0, pad)).reshape(n, -1).T for x in rows]


def train(text: Text, known: Vocabulary, weights: np.ndarray, turn: int) -> tuple[np.ndarray, int]:
    """The weights after this shard's updates of a round, and the number of tokens read. Each training token is in one round at least."""
    w = unflatten(weights)
    tokens = int(text.train().sum())
    if not tokens:
        return weights, 0
    n = min(tokens, int(np.clip(tokens // (FULL * WINDOW), LEAST_LANES, MOST_LANES)))
    arrays = stretches(text, n, *known.inputs(text))
    starts = range(0, len(arrays[0]), WINDOW)
    small = len(starts) < FULL
    own = list(starts) if small else [t for k, t in enumerate(starts) if k * ROUNDS // len(starts) == turn]
    own *= max(1, -(-LEAST_UPDATES // len(own))) if small else 1
    m, v = {x: np.zeros_like(y) for x, y in w.items()}, {x: np.zeros_like(y) for x, y in w.items()}
    h = np.zeros((n, STATE), np.float32)
    for k, t in enumerate(own, 1):
        first, valid, seen, kind, place = (x[t : t + WINDOW] for x in arrays)
        if t == 0:
            h = np.zeros((n, STATE), np.float32)
        g, h, _ = gradients(w, known, h, seen, kind, place, first, valid)
        rate = RATE * (1 - (turn + k / (len(own) + 1)) / ROUNDS)
        for x in w:
            m[x] += 0.1 * (g[x] - m[x])
            v[x] += 0.01 * (g[x] * g[x] - v[x])
            w[x] -= np.float32(rate / (1 - 0.9**k)) * m[x] / (np.sqrt(v[x] / np.float32(1 - 0.99**k)) + np.float32(1e-8))
    return flatten(w), int(arrays[1][: len(arrays[0])].sum()) if small else sum(int(arrays[1][t : t + WINDOW].sum()) for t in own)


def network_scores(text: Text, known: Vocabulary, w: dict) -> np.ndarray:
    """log10 of each token's class, and of a frequent word in it, given all tokens before it in its document."""
    inputs, kinds, places = known.inputs(text)
    out = np.zeros(len(text.word))
    longest = int(np.diff(text.bounds).max(initial=1))
    n = int(np.clip(len(out) // longest, 16, 256))
    h = np.zeros((n, STATE), np.float32)
    place, first = lanes(text.bounds, np.arange(len(text.ids)), n)
    for t in range(0, len(place), SCORED):
        p, f = place[t : t + SCORED], first[t : t + SCORED]
        states = forward(w, h, np.where(f, inputs[0], inputs[text.word[np.maximum(p - 1, 0)]]), f)  # names[0] is the end
        h = states[-1]
        valid = p >= 0
        word = text.word[p[valid]]
        out[p[valid]] = log_probabilities(w, known, states[valid], kinds[word], places[word]) / np.log(10)
    return out


_TEXT = "shard int, " + ", ".join(f"{k} binary" for k, _ in Text.FIELDS)
_ENTRY = (["bucket", "shard", "names", "counts", "forms"], [pa.int32(), pa.int32(), *[pa.binary()] * 3])
_REPLY = (["shard", "bucket", "counts", "top", "tokens", "distinct"], [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.list_(pa.int64())), *[pa.list_(pa.int64())] * 2])


def _bucket_of(names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = (mix(names) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def _tokens(key, rows):
    return as_table([(key[0].as_py(), *Text.read(rows).packed())], ["shard", *(k for k, _ in Text.FIELDS)], [pa.int32(), *[pa.binary()] * len(Text.FIELDS)])


def _count(n: int):
    def run(batches):
        for row in rows_of(batches):
            text = Text.unpacked(row)
            counts = text.counts()
            order, cut = _bucket_of(text.names, n)
            own = [(b, order[cut[b] : cut[b + 1]]) for b in np.flatnonzero(np.diff(cut)).tolist()]
            out = [(b, row["shard"], pack(text.names[k]), pack(counts[k].astype(np.uint32)), pack(text.forms[k])) for b, k in own]
            yield from as_table(out, *_ENTRY).to_batches()

    return run


def _total(key, rows):
    """Counts over all shards for each of them; under shard -1 the bucket's most frequent words and its sums by form."""
    rows = rows.sort_by("shard")
    read = lambda c, t: [unpack(x.as_py(), t) for x in rows.column(c)]
    names, counts, kinds = read("names", np.uint64), read("counts", np.uint32), read("forms", np.uint8)
    every, first, back = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
    total = np.bincount(back, np.concatenate(counts), len(every)).astype(np.int64)
    form = np.concatenate(kinds)[first].astype(np.int64)
    out, at = [], 0
    for s, x in zip(rows.column("shard").to_pylist(), names):
        out.append((s, key[0].as_py(), pack(total[back[at : at + len(x)]]), None, None, None))
        at += len(x)
    best = np.lexsort((every, -total))[:TOP]
    best = best[total[best] > 0]
    top = np.stack([every[best].view(np.int64), total[best], form[best]], axis=1).tolist()
    sums = [np.bincount(form, x, FORMS).astype(np.int64).tolist() for x in (total, total > 0)]
    return as_table([*out, (-1, key[0].as_py(), None, top, *sums)], *_REPLY)


def _vocabulary(replies: DataFrame) -> Vocabulary:
    """At most TOP words and the sums by form come to the driver."""
    sums = replies.where("shard = -1")
    got = sums.select(F.explode("top").alias("t")).select(*[F.col("t")[k].alias(x) for k, x in enumerate(("name", "n", "form"))]).orderBy(F.desc("n"), "name").limit(TOP).collect()
    each = sums.agg(*[F.coalesce(F.sum(F.col(c)[k]), F.lit(0)) for c in ("tokens", "distinct") for k in range(FORMS)]).first()
    return Vocabulary.build([tuple(r) for r in got], np.array(each[:FORMS], np.int64), np.array(each[FORMS:], np.int64))


def _average(key, rows):
    rows = rows.sort_by("was")
    read = np.array(rows.column("read").to_pylist(), float)
    share = read / read.sum() if read.sum() else np.full(len(read), 1 / len(read))
    total = sum(s * unpack(x.as_py(), np.float32).astype(np.float64) for s, x in zip(share, rows.column("weights")))
    return as_table([(key[0].as_py(), int(read.sum()), pack(total.astype(np.float32)))], ["part", "read", "weights"], [pa.int64(), pa.int64(), pa.binary()])


def _trained(texts: DataFrame, n: int, known: Vocabulary) -> np.ndarray:
    """The network after all rounds; one network at a time comes to the driver."""
    weights = flatten(start_weights())
    for turn in range(ROUNDS):

        def run(batches, weights=weights, turn=turn):
            for row in rows_of(batches):
                w, read = train(Text.unpacked(row), known, weights, turn)
                yield from as_table([(row["shard"], read, pack(w))], ["part", "read", "weights"], [pa.int64(), pa.int64(), pa.binary()]).to_batches()

        parts, left = texts.mapInArrow(run, "part long, read long, weights binary"), n
        while left:
            near = parts.select(F.col("part").alias("was"), F.expr(f"part div {MERGED}").alias("part"), "read", "weights")
            parts, left = near.groupBy("part").applyInArrow(_average, "part long, read long, weights binary"), (left - 1) // MERGED
        row = parts.first()
        weights = unpack(row["weights"], np.float32) if row else weights
    return weights


def _score(n: int, known: Vocabulary, weights: np.ndarray):
    def run(key, rows, replies):
        text = Text.unpacked(rows.to_pylist()[0])
        order, cut = _bucket_of(text.names, n)
        counts = np.zeros(len(text.names), np.int64)
        for b, c in zip(replies.column("bucket").to_pylist(), replies.column("counts")):
            counts[order[cut[b] : cut[b + 1]]] = unpack(c.as_py(), np.int64)
        base = np.log10((counts + SMOOTH) / (known.total + SMOOTH * (known.words + 1)))
        within = np.log10((counts + SMOOTH) / (known.tokens[text.forms] + SMOOTH * (known.distinct[text.forms] + 1)))
        within[known.find(text.names) >= 0] = 0
        score = network_scores(text, known, unflatten(weights)) + within[text.word]
        per = lambda x: np.add.reduceat(x, text.bounds[:-1])  # noqa: E731  every document has a token
        columns = [pa.array(text.ids, pa.int64(), mask=text.ids == NO_ID), pa.array(text.out), pa.array(np.diff(text.bounds), pa.int64()), pa.array(per((counts > 0)[text.word].astype(np.int64)), pa.int64())]
        columns += [pa.array(np.full(len(text.ids), known.total), pa.int64()), pa.array(per(base[text.word])), pa.array(per(score))]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def lm_scores(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    n = shard_count(docs, shard_bytes, SHARDS, SMALL_BYTES)
    texts = cut_lineage(sharded(docs, n).groupBy("shard").applyInArrow(_tokens, _TEXT))
    entries = texts.mapInArrow(_count(n), "bucket int, shard int, names binary, counts binary, forms binary")
    replies = cut_lineage(entries.groupBy("bucket").applyInArrow(_total, "shard int, bucket int, counts binary, top array<array<long>>, tokens array<long>, distinct array<long>"))
    known = _vocabulary(replies)
    weights = _trained(texts, n, known)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = replies.where("shard >= 0").select("shard", "bucket", "counts")
    return texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_score(n, known, weights), schema)


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))

"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy, over all windows of a text.

A word reaches the network as a vector of three parts: an embedding of the word, by its hash; the mean of embeddings of
its runs of 3 bytes, its ends marked, by theirs; and the log-odds, counted on labelled texts, of the word, of its
beginnings of 3 to 6 bytes and of the 4 bytes anywhere in it. Embeddings are trained with the network and begin at zero,
so that a bucket that training never meets tells nothing; a step changes only those that its texts meet. A share of the
texts of each step is taught without their odds, so that words and their bytes tell what they can by themselves. Odds count only where their log-likelihood ratio is beyond
chance for the number of entries tried; the odds of a text in training come from FOLDS parts of the labels, those that
the text is not in, so that the network meets them as it will on new texts.

Windows have WINDOW words and overlap by half; each runs through the network in both directions, attention pools the
states, and a text's score is that of its highest window.

Training takes at most LABELLED labelled texts, those of least hash of their id, up to LABELLED_BYTES of text; never a
row whose crc32(id as text) mod 4 is 2. Labels, language, source and id are no inputs.

Defined results: a null or empty text, or one without words, has one empty window; without labels of both kinds the
score of every text is the share of toxic labels, 0 if there is none; rows that repeat have equal scores; of labels that
repeat an id, and of texts that do, the toxic label and the least text count; an empty table gives an empty one; other
columns are not looked at, whatever their names. A very long text has a window for every STRIDE words of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import LOWER, U64, Rolling, Scratch, mix, steps, table

WINDOW, STRIDE = 24, 12
CHANNELS, HIDDEN = 3, 8
#: Buckets and width of the embeddings of words, and of runs of RUN bytes.
WORD_BUCKETS, RUN_BUCKETS, WIDTH = 1 << 14, 1 << 12, 12
INPUTS = CHANNELS + 2 * WIDTH
BEGINNINGS = (3, 4, 5, 6)
INNER, RUN = 4, 3
LABELLED, LABELLED_BYTES = 3000, 24_000_000
FOLDS = 6
#: Passes over the labelled texts, more if they make fewer than STEPS steps; every MINED passes windows are chosen anew.
EPOCHS, STEPS, BATCH, RATE, DECAY = 10, 150, 64, 0.01, 0.1
#: Share of texts of a batch that are taught without their odds, so that the embeddings learn too.
MUTED = 0.15
MINED = 4
AT_LEAST = 0.3
HASH = Rolling(31)
#: Windows that run at a time.
AT_ONCE = 4096

PART = np.zeros(256, bool)
PART[128:] = True
PART[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def words_of(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the text each is in."""
    n = len(b)
    solid = PART[b]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    start, stop = solid.copy(), solid.copy()
    if n:
        start[1:] &= ~solid[:-1] | edge[1:n]
        stop[:-1] &= ~solid[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(ends, s, "right") - 1


class Words:
    """The words of some texts: which text each is in, its number among the different ones, and what those are made of."""

    def __init__(self, b: np.ndarray, ends: np.ndarray):
        s, e, self.doc = words_of(b, ends)
        self.per_doc = np.bincount(self.doc, minlength=len(ends) - 1)
        p = HASH.prefix(LOWER[b])
        self.hash, first, self.which = np.unique(HASH.of(p, s, e), return_index=True, return_inverse=True)
        s, e = s[first], e[first]
        self.found = [(0, np.arange(len(s)), self.hash)]
        for k in BEGINNINGS:
            long = np.flatnonzero(e - s >= k)
            self.found.append((1, long, HASH.of(p, s[long], s[long] + k) ^ U64(k)))
        word, at = self._runs(s, e, INNER)
        self.found.append((2, word, HASH.of(p, at, at + INNER) ^ U64(0x5EED)))
        # runs of bytes with the ends marked: a word of fewer bytes is one run
        word, at = self._runs(s, e, RUN)
        short = np.flatnonzero(e - s < RUN)
        end = (at == s[word]).astype(U64) + (at + RUN == e[word]).astype(U64) * U64(2)
        runs = [HASH.of(p, at, at + RUN) ^ mix(end + U64(9)), HASH.of(p, s[short], e[short]) ^ U64(0xE11D)]
        self.run_word = np.concatenate((word, short))
        self.run = (np.concatenate(runs) & U64(RUN_BUCKETS - 1)).astype(np.int64)
        self.run_share = (1 / np.bincount(self.run_word, minlength=len(s))[self.run_word]).astype(np.float32)

    @staticmethod
    def _runs(s: np.ndarray, e: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The word and the place of each run of k bytes."""
        long = np.flatnonzero(e - s >= k)
        count = (e - s)[long] - k + 1
        word = np.repeat(long, count)
        return word, np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + s[word]

    def entries(self, channel: int) -> tuple[np.ndarray, np.ndarray]:
        """The different (hash, text) of a channel."""
        words = [(w, h) for c, w, h in self.found if c == channel]
        number, hashes = np.concatenate([w for w, _ in words]), np.concatenate([h for _, h in words])
        order = np.argsort(number, kind="stable")
        number, hashes = number[order], hashes[order]
        at = np.searchsorted(number, np.arange(len(self.hash) + 1))
        pair = np.unique(self.doc * len(self.hash) + self.which) if len(self.hash) else np.zeros(0, np.int64)
        doc, which = np.divmod(pair, max(1, len(self.hash)))
        many = np.diff(at)[which]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(at[which], many)
        h, d = hashes[place], np.repeat(doc, many)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        first = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
        return h[first], d[first]

    def odds(self, lookups: list[Lookup]) -> np.ndarray:
        """The channels of each different word."""
        out = np.zeros((len(self.hash), CHANNELS), np.float32)
        for c, word, h in self.found:
            some, v = lookups[c](h)
            np.maximum.at(out[:, c], word[some], v)
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows of all texts, one at least for each: the text, the first word, the length."""
        last = np.maximum(0, -(-(self.per_doc - WINDOW) // STRIDE))
        doc = np.repeat(np.arange(len(last)), last + 1)
        j = np.arange(len(doc)) - np.repeat(np.cumsum(last + 1) - last - 1, last + 1)
        first = np.cumsum(self.per_doc) - self.per_doc
        return doc, first[doc] + j * STRIDE, np.minimum(self.per_doc[doc] - j * STRIDE, WINDOW)


class Lookup:
    """Values of 64-bit keys. A filter of a bit for each value of some low bits spares most searches; the search is exact."""

    BITS = 20

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.known = np.zeros(1 << self.BITS, bool)
        self.known[(self.keys & U64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in h that have a value, and the values."""
        some = np.flatnonzero(self.known[(h & U64((1 << self.BITS) - 1)).astype(np.int64)])
        at = np.searchsorted(self.keys, h[some])
        same = self.keys[np.minimum(at, len(self.keys) - 1)] == h[some] if len(self.keys) else np.zeros(0, bool)
        return some[same], self.values[at[same]]


def learn_entries(keys: np.ndarray, docs: np.ndarray, toxic: np.ndarray, part: np.ndarray) -> Lookup:
    """From (hash, text) pairs of the texts in part: the entries that toxic texts have beyond chance, with their log-odds, 0..1 or so."""
    keys, docs = keys[part[docs]], docs[part[docs]]
    n, bad = part.sum(), toxic[part].sum()
    if not 0 < bad < n:
        return Lookup(np.zeros(0, U64), np.zeros(0))
    share = bad / n
    key, inverse = np.unique(keys, return_inverse=True)
    one = np.bincount(inverse, toxic[docs], minlength=len(key))
    all_ = np.bincount(inverse, minlength=len(key))
    zero = all_ - one
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(one > 0, one * np.log(one / (all_ * share)), 0) + np.where(zero > 0, zero * np.log(zero / (all_ * (1 - share))), 0))
    odds = np.log((one + 0.5) / (bad + 1)) - np.log((zero + 0.5) / (n - bad + 1))
    keep = (g >= 2 * np.log(max(2, len(key)))) & (odds > 1)
    return Lookup(key[keep], odds[keep] / 5)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Embeddings, gated recurrent units in both directions, attention over their states, one output."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) * 0.3).astype(np.float32)
        self.w = {f"{k}{d}": v for d in "fb" for k, v in (("W", draw(INPUTS, 3 * HIDDEN)), ("U", draw(HIDDEN, 3 * HIDDEN)), ("b", np.zeros(3 * HIDDEN, np.float32)))}
        self.w |= {"att": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        self.w |= {"words": np.zeros((WORD_BUCKETS, WIDTH), np.float32), "runs": np.zeros((RUN_BUCKETS, WIDTH), np.float32)}

    def vectors(self, words: Words, odds: np.ndarray) -> np.ndarray:
        """The inputs of each different word; behind them one row of zeros, for places without a word."""
        out = np.zeros((len(words.hash) + 1, INPUTS), np.float32)
        out[:-1, :CHANNELS] = odds
        out[:-1, CHANNELS : CHANNELS + WIDTH] = self.w["words"][(words.hash & U64(WORD_BUCKETS - 1)).astype(np.int64)]
        runs = self.w["runs"][words.run] * words.run_share[:, None]
        for k in range(WIDTH):
            out[:-1, CHANNELS + WIDTH + k] = np.bincount(words.run_word, runs[:, k], minlength=len(words.hash))
        return out

    def _run(self, gates: np.ndarray, on: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, steps_ = gates.shape[:2]
        h, states, held = np.zeros((n, HIDDEN), np.float32), np.zeros((n, steps_, HIDDEN), np.float32), []
        for t in range(steps_) if d == "f" else reversed(range(steps_)):
            gx, gh = gates[:, t], h @ self.w["U" + d]
            zr = _sigmoid(gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(gx[:, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
            m = on[:, t : t + 1]
            new = np.where(m, (1 - z) * c + z * h, h)
            if keep:
                held.append((t, h, z, r, c, gh[:, 2 * HIDDEN :], m))
            h = states[:, t] = new
        return states, held

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.w["W" + d] + self.w["b" + d] for d in "fb"}

    def forward(self, x: np.ndarray, length: np.ndarray, keep: bool = False):
        """The scores of windows of words, whose inputs are x."""
        return self.pooled(self.gates(x), length, keep)

    def pooled(self, gates: dict[str, np.ndarray], length: np.ndarray, keep: bool = False):
        on = np.arange(gates["f"].shape[1])[None, :] < np.maximum(length, 1)[:, None]  # an empty text is one empty word
        f, hf = self._run(gates["f"], on, "f", keep)
        b, hb = self._run(gates["b"], on, "b", keep)
        s = np.concatenate((f, b), axis=2)
        e = np.where(on, s @ self.w["att"], -1e9)
        a = np.exp(e - e.max(axis=1, keepdims=True)) * on
        a = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", a, s)
        p = _sigmoid(pooled @ self.w["out"] + self.w["bias"])
        return (p, (on, s, a, pooled, hf, hb)) if keep else p

    def gradients(self, x: np.ndarray, length: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss by the weights, but the embeddings, and by the inputs x."""
        p, (on, s, a, pooled, hf, hb) = self.forward(x, length, keep=True)
        g = ((p - y) / len(y)).astype(np.float32)
        out = {"out": pooled.T @ g, "bias": np.array([g.sum()], np.float32)}
        dp = g[:, None] * self.w["out"]
        ds = a[:, :, None] * dp[:, None, :]
        da = np.einsum("nh,nth->nt", dp, s)
        de = a * (da - (a * da).sum(axis=1, keepdims=True))
        out["att"] = np.einsum("nt,nth->h", de, s)
        ds += de[:, :, None] * self.w["att"]
        dx = out["x"] = np.zeros_like(x)
        for d, held, part in (("f", hf, ds[:, :, :HIDDEN]), ("b", hb, ds[:, :, HIDDEN:])):
            W, U, B = (np.zeros_like(self.w[k + d]) for k in "WUb")
            dh = np.zeros((len(y), HIDDEN), np.float32)
            for t, h, z, r, c, uh, m in reversed(held):
                dh = dh + part[:, t]
                new = dh * m
                dc = new * (1 - z) * (1 - c * c)
                dz = new * (h - c) * z * (1 - z)
                dr = dc * uh * r * (1 - r)
                gx = np.concatenate((dz, dr, dc), axis=1)
                gh = np.concatenate((dz, dr, dc * r), axis=1)
                W += x[:, t].T @ gx
                dx[:, t] += gx @ self.w["W" + d].T
                B += gx.sum(axis=0)
                U += h.T @ gh
                dh = dh * ~m + new * z + gh @ self.w["U" + d].T
            out["W" + d], out["U" + d], out["b" + d] = W, U, B
        return out


def _placed(first: np.ndarray, length: np.ndarray, which: np.ndarray, blank: int) -> np.ndarray:
    """The number of the word at each place of windows; blank behind their ends."""
    place = np.arange(WINDOW)[None, :]
    at = np.append(which, blank)[np.minimum(first[:, None] + place, len(which))]
    return np.where(place < length[:, None], at, blank)


def window_scores(net: Network, words: Words, odds: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    gates = net.gates(net.vectors(words, odds))
    out = np.zeros(len(first))
    for a in range(0, len(first), AT_ONCE):
        at = _placed(first[a : a + AT_ONCE], length[a : a + AT_ONCE], words.which, len(words.hash))
        out[a : a + AT_ONCE] = net.pooled({d: g[at] for d, g in gates.items()}, length[a : a + AT_ONCE])
    return out


def train(parts: list[tuple[int, Words, np.ndarray]], toxic: np.ndarray) -> Network:
    """Each text stands for its highest window, found anew every few passes; an empty window of each length, from none,
    counts as clean beside them. parts holds (first text, words, their odds)."""
    net, r = Network(), np.random.default_rng(9)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    seen = {k: np.zeros(len(net.w[k])) for k in ("words", "runs")}
    step, passes = 0, max(EPOCHS, -(-STEPS // max(1, (len(toxic) + WINDOW + 1) // BATCH)))
    for epoch in range(passes):
        if epoch % MINED == 0:
            chosen, lengths, of = [], [], []
            for n, (i, words, odds) in enumerate(parts):
                doc, first, length = words.windows()
                if epoch:
                    p = window_scores(net, words, odds, first, length)
                else:
                    at = np.append(0.0, np.cumsum(odds.sum(axis=1)[words.which]))
                    p = at[first + length] - at[first]
                order = np.lexsort((p, doc))
                top = order[np.append(doc[order][1:] != doc[order][:-1], True)]
                chosen.append(_placed(first[top], length[top], words.which, len(words.hash)))
                lengths.append(length[top])
                of.append(np.full(len(top), n))
            empty = np.arange(WINDOW + 1)
            chosen, lengths, of = np.concatenate((*chosen, np.full((len(empty), WINDOW), -1))), np.concatenate((*lengths, empty)), np.concatenate((*of, np.full(len(empty), -1)))
            y = np.concatenate((toxic, np.zeros(len(empty)))).astype(np.float32)
        for batch in np.array_split(r.permutation(len(y)), max(1, len(y) // BATCH)):
            step += 1
            x, taught = np.zeros((len(batch), WINDOW, INPUTS), np.float32), []
            for n in np.unique(of[batch]):
                rows = np.flatnonzero(of[batch] == n)
                if n < 0:
                    continue
                words, odds = parts[n][1:]
                some, at = np.unique(chosen[batch[rows]], return_inverse=True)
                small = _some_words(words, some[some < len(words.hash)])
                at = at.reshape(len(rows), WINDOW)
                x[rows] = net.vectors(small, odds[some[some < len(words.hash)]])[np.minimum(at, len(small.hash))]
                taught.append((rows, at, small))
            x[r.random(len(batch)) < MUTED, :, :CHANNELS] = 0
            g = net.gradients(x, lengths[batch], y[batch])
            dx = g.pop("x")
            g["words"], g["runs"] = np.zeros_like(net.w["words"]), np.zeros_like(net.w["runs"])
            for rows, at, small in taught:
                by_word = np.zeros((len(small.hash) + 1, 2 * WIDTH), np.float32)
                np.add.at(by_word, np.minimum(at, len(small.hash)), dx[rows][:, :, CHANNELS:])
                np.add.at(g["words"], (small.hash & U64(WORD_BUCKETS - 1)).astype(np.int64), by_word[:-1, :WIDTH])
                np.add.at(g["runs"], small.run, by_word[small.run_word, WIDTH:] * small.run_share[:, None])
            for k, d in g.items():
                m, v = moment[k]
                if k in ("words", "runs"):  # buckets that the batch doesn't meet stay as they are
                    met = np.flatnonzero(d.any(axis=1))
                    seen[k][met] += 1
                    m[met] += 0.1 * (d[met] - m[met])
                    v[met] += 0.001 * (d[met] * d[met] - v[met])
                    t = seen[k][met][:, None]
                    net.w[k][met] -= RATE * ((m[met] / (1 - 0.9**t)) / (np.sqrt(v[met] / (1 - 0.999**t)) + 1e-8) + DECAY * net.w[k][met])
                    continue
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                net.w[k] = net.w[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


class _Some:
    """What Network.vectors takes of some of the different words."""


def _some_words(words: Words, some: np.ndarray) -> _Some:
    out = _Some()
    out.hash = words.hash[some]
    at = np.searchsorted(some, words.run_word)
    on = np.append(some, -1)[at] == words.run_word
    out.run_word, out.run, out.run_share = at[on], words.run[on], words.run_share[on]
    return out


def fit(texts: list[str | None], toxic: np.ndarray) -> tuple[list[Lookup], Network] | float:
    """What scores texts: the entries and the network, or one score for all where labels are of one kind."""
    if not len(toxic) or toxic.all() or not toxic.any():
        return float(toxic.mean()) if len(toxic) else 0.0
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
    parts = [(i, Words(b, ends)) for i, _, b, ends in steps(batch)]
    fold = np.arange(len(toxic)) % FOLDS
    every, apart = [], [[] for _ in range(FOLDS)]
    for c in range(CHANNELS):
        pairs = [w.entries(c) for _, w in parts]
        h, d = np.concatenate([h for h, _ in pairs]), np.concatenate([d + i for (i, _), (_, d) in zip(parts, pairs)])
        every.append(learn_entries(h, d, toxic, np.ones(len(toxic), bool)))
        for f in range(FOLDS):
            apart[f].append(learn_entries(h, d, toxic, fold != f))
    taught = []
    for i, words in parts:
        # a word has other odds in texts of other folds, so it is another word there
        own = fold[i + words.doc]
        number, which = np.unique(own * (len(words.hash) + 1) + words.which, return_inverse=True)
        f, w = np.divmod(number, len(words.hash) + 1)
        odds = np.stack([words.odds(x) for x in apart])[f, w] if len(number) else np.zeros((0, CHANNELS), np.float32)
        taught.append((i, _spread(words, w, which), odds))
    return every, train(taught, toxic)


def _spread(words: Words, which_old: np.ndarray, which: np.ndarray) -> Words:
    """words with its different words numbered anew, some more than once; which_old gives the old number of each."""
    out = object.__new__(Words)
    out.doc, out.per_doc, out.which, out.hash = words.doc, words.per_doc, which, words.hash[which_old]
    order = np.argsort(words.run_word, kind="stable")
    at = np.searchsorted(words.run_word[order], np.arange(len(words.hash) + 1))
    many = np.diff(at)[which_old]
    place = order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(at[which_old], many)]
    out.run_word, out.run, out.run_share = np.repeat(np.arange(len(which_old)), many), words.run[place], words.run_share[place]
    return out


def score_texts(batch: pa.RecordBatch, model, column: str = "text") -> np.ndarray:
    """The score of each row's whole text."""
    out = np.zeros(len(batch))
    if isinstance(model, float):
        return out + model
    lookups, net = model
    for i, j, b, ends in steps(batch, column):
        words = Words(b, ends)
        doc, first, length = words.windows()
        p = window_scores(net, words, words.odds(lookups), first, length)
        best = np.zeros(j - i)
        np.maximum.at(best, doc, p)
        out[i:j] = best
    return out


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs; labels has (doc_id, toxic 0/1)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    held_out = lambda c: F.crc32(c.cast("string").cast("binary")) % 4 == 2
    some = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    some = scratch.write(some.orderBy(F.xxhash64("label_id"), "label_id").limit(labelled))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    taught = scratch.write(plain.join(F.broadcast(some), plain["id"] == some["label_id"]).groupBy("label_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))
    sizes = sorted(taught.select(F.xxhash64("label_id"), "label_id", F.coalesce(F.octet_length("text"), F.lit(0))).collect())
    total, chosen = 0, []
    for _, k, n in sizes:
        total += n
        if total > LABELLED_BYTES and chosen:
            break
        chosen.append(k)
    least = F.xxhash64("label_id")
    rows = sorted(taught.where(least <= sizes[len(chosen) - 1][0]).select(least, "text", "toxic").collect(), key=lambda r: r[0]) if chosen else []
    model = fit([r[1] for r in rows], np.array([r[2] for r in rows], float))
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(score_texts(batch, held.value))], names=["id", "score"])

    scored = plain.mapInArrow(run, "id long, score double")
    return scored.select("id", F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= AT_LEAST, 1).otherwise(0).alias("predicted"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")

"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

Each word enters as a word embedding and the mean of the embeddings of its GRAM-byte character grams. Forward and backward GRUs read a
window of WINDOW words; attention weighs their states; one logistic unit scores the window. A text's score is the highest
over all its windows, which overlap by WINDOW - STRIDE words. Training sees bounded samples of labelled rows: in a toxic
text the window that scores highest carries the label, in any other text every sampled window does.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.llm.common import map_texts, read

WINDOW, STRIDE, GRAM, THRESHOLD = 40, 20, 5, 0.3
#: Bounds of training: labelled documents drawn of each class, the longest text drawn (code points), and the vocabulary.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS, VOCABULARY, GRAMS = 1000, 2500, 20_000, 6000, 16_384
EMBED, CHARS, HIDDEN, STEPS, BATCH, RATE, SLOW, DECAY, DROP, SEED = 8, 8, 8, 240, 128, 0.015, 0.1, 0.3, 0.2, 7
#: The share of RATE that is gone at the last step, and the last steps whose weights are averaged.
FALL, AVERAGED = 0.85, 80
#: Words whose gates a worker keeps, and windows that it reads side by side.
CACHE_WORDS, SIDE_BY_SIDE = 150_000, 2048
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(flat gram numbers, sizes): the GRAM-byte grams of each `<word>`, all words at once; short words are padded to one."""
    parts = [f"<{w}>".encode("utf-8", "surrogatepass").ljust(GRAM, b">") for w in words]
    sizes = np.array([len(x) for x in parts]) - (GRAM - 1)
    b = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    flat = np.zeros(len(b) - GRAM + 1, np.int64)
    for k in range(GRAM):
        flat = flat * 263 + b[k : k + len(flat)]
    flat = (flat ^ flat >> 17) % GRAMS
    inside = np.ones(len(flat), bool)  # not across two words
    for k in range(1, GRAM):
        inside[np.cumsum(sizes + GRAM - 1)[:-1] - k] = False
    return flat[inside], sizes


class Network:
    """Parameters P: word and gram embeddings, the two GRUs (gates z, r, n), attention and output."""

    def __init__(self, vocabulary: list[str], prior: np.ndarray | None = None, gram_prior: np.ndarray | None = None):
        rng = np.random.default_rng(SEED)
        self.at = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0: any other word
        h, d = HIDDEN, EMBED + CHARS
        f = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.P = {"word": f(len(vocabulary) + 1, EMBED) * 0.1, "gram": f(GRAMS, CHARS) * 0.1, "att": f(2 * h), "out": f(2 * h), "bias": np.array([-1.0], np.float32)}
        if prior is not None:
            self.P["word"][1:, 0] = prior  # how much more often training saw the word in toxic texts
        if gram_prior is not None:
            self.P["gram"][:, 0] = gram_prior
        for way in "fb":
            self.P |= {f"W{way}": f(d, 3 * h), f"U{way}": f(h, 3 * h), f"c{way}": np.zeros(3 * h, np.float32)}

    def embed(self, words: list[str]) -> np.ndarray:
        flat, sizes = grams_of(words)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        means = np.add.reduceat(self.P["gram"][flat], starts, axis=0) / sizes[:, None].astype(np.float32)
        return np.concatenate([self.P["word"][[self.at.get(w, 0) for w in words]], means], axis=1)

    def scores(self, rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray | None) -> np.ndarray:
        """Probabilities of windows. ids (steps, n): rows of input gates, 3h forward and 3h backward; sizes: None if all are full."""
        steps, n, h = *ids.shape, HIDDEN
        states = np.empty((steps, 2, h, n), np.float32)
        live = None if sizes is None else (np.arange(steps)[:, None] < sizes[None, :]).astype(np.float32)
        u_zr = np.stack([self.P[f"U{w}"][:, : 2 * h].T for w in "fb"])
        u_n = np.stack([self.P[f"U{w}"][:, 2 * h :].T for w in "fb"])
        s = np.zeros((2, h, n), np.float32)
        x = np.empty((2, 3 * h, n), np.float32)
        for t in range(steps):  # forward at t, backward at the mirror place, side by side
            back = steps - 1 - t
            x[0], x[1] = rows[ids[t], : 3 * h].T, rows[ids[back], 3 * h :].T
            zr = np.matmul(u_zr, s)
            zr += x[:, : 2 * h]
            _gate(zr)
            z, new = zr[:, :h], np.matmul(u_n, zr[:, h:] * s)
            new += x[:, 2 * h :]
            np.tanh(new, out=new)
            new -= s
            new *= z
            if live is not None:
                new[0] *= live[t]
                new[1] *= live[back]
            s = s + new
            states[t, 0], states[back, 1] = s[0], s[1]
        att = self.P["att"]
        e = np.einsum("tkn,k->tn", states.reshape(steps, 2 * h, n), att)
        if live is not None:
            e = np.where(live > 0, e, np.float32(-1e9))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        seen = np.einsum("tkn,k->tn", states.reshape(steps, 2 * h, n), self.P["out"])
        return _sigmoid((w * seen).sum(axis=0) + self.P["bias"][0])


def _gate(x):
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def windows_of(n: int) -> list[tuple[int, int]]:
    """(start, end) of the overlapping windows that cover n words."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = list(range(0, n - WINDOW, STRIDE))
    return [(s, s + WINDOW) for s in starts] + [(n - WINDOW, n)]


class Trainer:
    """Adam on mini-batches of windows."""

    def __init__(self, net: Network):
        self.net, self.t = net, 0
        self.m = {k: np.zeros_like(v) for k, v in net.P.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.P.items()}

    def step(self, windows: list[list[str]], y: np.ndarray):
        """One batch: windows of words and their labels."""
        P, h = self.net.P, HIDDEN
        at = {w: i for i, w in enumerate(dict.fromkeys(w for x in windows for w in x))}
        sizes = np.array([len(w) for w in windows])
        n, steps = len(windows), int(sizes.max())
        live = (np.arange(steps)[None, :] < sizes[:, None]).astype(np.float32)
        inv = np.zeros((n, steps), np.int64)
        inv[live > 0] = [at[w] for x in windows for w in x]
        x = self.net.embed(list(at))[inv]
        memo, states = {}, np.zeros((n, steps, 2 * h), np.float32)
        for w, way in enumerate("fb"):
            U, s = P[f"U{way}"], np.zeros((n, h), np.float32)
            g = x @ P[f"W{way}"] + P[f"c{way}"]
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                zr = _gate(g[:, t, : 2 * h] + s @ U[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(g[:, t, 2 * h :] + (r * s) @ U[:, 2 * h :])
                memo[way, t] = (s, z, r, new)
                s = s + live[:, t, None] * z * (new - s)
                states[:, t, w * h : (w + 1) * h] = s
        e = np.where(live > 0, states @ P["att"], -1e9)
        a = np.exp(e - e.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = np.einsum("nt,ntk->nk", a, states)
        p = _sigmoid(pooled @ P["out"] + P["bias"][0])
        G = {k: np.zeros_like(v) for k, v in P.items()}
        dl = (p - y) / n
        G["out"], G["bias"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
        dpool = dl[:, None] * P["out"]
        dstates = a[:, :, None] * dpool[:, None, :]
        da = np.einsum("ntk,nk->nt", states, dpool)
        de = a * (da - (a * da).sum(1, keepdims=True))
        G["att"] = np.einsum("nt,ntk->k", de, states)
        dstates = dstates + de[:, :, None] * P["att"]
        dx = np.zeros_like(x)
        for w, way in enumerate("fb"):
            W, U, ds = P[f"W{way}"], P[f"U{way}"], np.zeros((n, h), np.float32)
            dg = np.zeros((n, steps, 3 * h), np.float32)
            for t in range(steps - 1, -1, -1) if way == "f" else range(steps):
                s, z, r, new = memo[way, t]
                ds = ds + dstates[:, t, w * h : (w + 1) * h]
                d = live[:, t, None] * ds
                dnew = d * z * (1 - new * new)
                dz = d * (new - s) * z * (1 - z)
                drs = dnew @ U[:, 2 * h :].T
                dr = drs * s * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                G[f"U{way}"][:, : 2 * h] += s.T @ dzr
                G[f"U{way}"][:, 2 * h :] += (r * s).T @ dnew
                dg[:, t] = np.concatenate([dzr, dnew], axis=1)
                ds = ds - d * z + dzr @ U[:, : 2 * h].T + drs * r
            G[f"W{way}"] = np.einsum("ntd,ntg->dg", x, dg)
            G[f"c{way}"] = dg.sum((0, 1))
            dx += dg @ W.T
        order = np.argsort(inv, axis=None, kind="stable")
        cuts = np.searchsorted(inv.ravel()[order], np.arange(len(at)))
        per_word = np.add.reduceat((dx * live[:, :, None]).reshape(n * steps, -1)[order], cuts, axis=0)
        np.add.at(G["word"], [self.net.at.get(w, 0) for w in at], per_word[:, :EMBED])
        flat, lengths = grams_of(list(at))
        np.add.at(G["gram"], flat, np.repeat(per_word[:, EMBED:] / lengths[:, None], lengths, axis=0).astype(np.float32))
        rate = RATE * (1 - FALL * min(1.0, self.t / STEPS))
        self.t += 1
        for k, g in G.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            if k in ("word", "gram"):
                P[k] *= 1 - rate * DECAY
            P[k] -= (rate * (SLOW if k in ("word", "gram") else 1.0) * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-7)).astype(np.float32)


class Scorer:
    """A trained network with the input gates of the words already met."""

    def __init__(self, net: Network):
        self.net = net
        self._clear()

    def _clear(self):
        self.at: dict[str, int] = {"": 0}
        self.rows = np.zeros((4096, 6 * HIDDEN), np.float32)

    def _add(self, words: list[str]) -> None:
        """Gates of new words: their inputs through both directions' input weights."""
        P, first = self.net.P, len(self.at)
        x = self.net.embed(words)
        while first + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[first : first + len(words)] = np.concatenate([x @ P["Wf"] + P["cf"], x @ P["Wb"] + P["cb"]], axis=1)
        self.at.update(zip(words, range(first, first + len(words)), strict=True))

    def texts(self, texts: list[str | None]) -> list[float]:
        """Scores of texts: the highest over their windows. A text without words scores 0."""
        best = np.zeros(len(texts))
        for i, p in self.windows([words_of(t) for t in texts]):
            np.maximum.at(best, i, p)
        return best.tolist()

    def windows(self, texts: list[list[str]]):
        """(text numbers, probabilities) of the overlapping windows of texts, some at a time; windows of a text stay in order."""
        if len(self.at) > CACHE_WORDS:
            self._clear()
        at = self.at
        fresh = list(dict.fromkeys(w for words in texts for w in words if w not in at))
        for k in range(0, len(fresh), 65_536):
            self._add(fresh[k : k + 65_536])
        return self.of_ids([np.array([at[w] for w in words], dtype=np.int32) for words in texts])

    def of_ids(self, texts: list[np.ndarray]):
        """As windows(), of the rows of words that are known."""
        full: list[tuple[int, np.ndarray]] = []
        short: list[tuple[int, np.ndarray]] = []
        held = 0
        for i, ids in enumerate(texts):
            if len(ids) >= WINDOW:
                starts = np.array([a for a, _ in windows_of(len(ids))])
                full.append((i, ids[starts[:, None] + np.arange(WINDOW)]))
                held += len(starts)
            elif len(ids):
                short.append((i, ids))
            if held >= SIDE_BY_SIDE:
                yield from self._full(full)
                full, held = [], 0
        yield from self._full(full)
        for k in range(0, len(short), SIDE_BY_SIDE):
            some = short[k : k + SIDE_BY_SIDE]
            sizes = np.array([len(x) for _, x in some])
            ids = np.zeros((len(some), int(sizes.max())), np.int32)
            ids[np.arange(ids.shape[1])[None, :] < sizes[:, None]] = np.concatenate([x for _, x in some])
            yield np.array([i for i, _ in some]), self.net.scores(self.rows, ids.T, sizes)

    def _full(self, some: list[tuple[int, np.ndarray]]):
        if not some:
            return
        owner = np.concatenate([np.full(len(x), i) for i, x in some])
        ids = np.concatenate([x for _, x in some])
        for at in range(0, len(ids), SIDE_BY_SIDE):
            part = np.ascontiguousarray(ids[at : at + SIDE_BY_SIDE].T)
            yield owner[at : at + SIDE_BY_SIDE], self.net.scores(self.rows, part, None)


def _evidence(a: int, n: int, b: int, m: int) -> float:
    """How many standard errors apart a word's shares of toxic (a of n) and other (b of m) texts are."""
    p = (a + b + 1) / (n + m + 2)
    return (a / max(n, 1) - b / max(m, 1)) / (p * (1 - p) * (1 / max(n, 1) + 1 / max(m, 1))) ** 0.5


def train(rows: list[tuple[str, int]]) -> Network:
    """A network from (text, label) rows; deterministic for equal rows in equal order. Texts are numbers of words meanwhile."""
    rng = np.random.default_rng(SEED)
    number: dict[str, int] = {}
    texts = [(np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32), y) for t, y in rows]
    texts = [(ids, y) for ids, y in texts if len(ids)]
    every = list(number)
    seen, grams = np.zeros((2, len(every)), np.int64), np.zeros((2, GRAMS), np.int64)
    sizes = [sum(y == k for _, y in texts) for k in (0, 1)]
    for ids, y in texts:
        own = np.unique(ids)
        seen[y][own] += 1
        grams[y][np.unique(grams_of([every[i] for i in own])[0])] += 1
    both = seen.sum(axis=0)
    chosen = sorted(np.flatnonzero(both >= 5).tolist(), key=lambda i: (-both[i], every[i]))[:VOCABULARY]
    prior = np.array([_evidence(int(seen[1][i]), sizes[1], int(seen[0][i]), sizes[0]) for i in chosen], np.float32)
    gram_prior = np.array([_evidence(int(a), sizes[1], int(b), sizes[0]) if a + b >= 5 else 0.0 for a, b in zip(grams[1], grams[0], strict=True)], np.float32)
    net = Network([every[i] for i in chosen], np.clip(prior, -10, 10) / 4 if chosen else None, np.clip(gram_prior, -10, 10) / 2)
    if not texts or not all(sizes):
        net.P["bias"][0] = 4.0 if sizes[1] else -4.0
        net.P["out"][:] = 0
        return net
    trainer = Trainer(net)
    summed = {k: np.zeros_like(v) for k, v in net.P.items()}
    inputs = net.embed(every)
    weight = np.maximum(inputs[:, 0], 2 * inputs[:, EMBED])
    del inputs
    epoch = -1
    while trainer.t < STEPS:
        epoch += 1
        if epoch == 0:  # at first, the window with the words most peculiar to toxic texts
            hardest = [int(np.argmax([weight[ids[a:b]].max() for a, b in windows_of(len(ids))])) for ids, _ in texts]
        else:
            hardest = _hardest(net, every, [ids for ids, _ in texts])
        picked: list[tuple[int, tuple[int, int]]] = []
        for i, ((ids, y), at) in enumerate(zip(texts, hardest, strict=True)):
            own = windows_of(len(ids))
            picked.append((i, own[at]))
            if not y and len(own) > 1:
                picked.append((i, own[int(rng.integers(len(own)))]))
        order = rng.permutation(len(picked))
        for at in range(0, len(order), BATCH)[: STEPS - trainer.t]:
            some = [picked[i] for i in order[at : at + BATCH]]
            words = [[every[k] for k in texts[i][0][a:b]] for i, (a, b) in some]
            lost = [rng.random(len(w)) < DROP for w in words]  # a word now and then, so that single texts are not learned by heart
            trainer.step([[v for v, x in zip(w, out, strict=True) if not x] or w for w, out in zip(words, lost, strict=True)], np.array([texts[i][1] for i, _ in some], np.float32))
            if trainer.t > STEPS - AVERAGED:
                for k, v in net.P.items():
                    summed[k] += v
    net.P |= {k: v / AVERAGED for k, v in summed.items()}
    return net


def _hardest(net: Network, every: list[str], texts: list[np.ndarray]) -> list[int]:
    """Of each text (numbers of words in every), the window that scores highest."""
    scorer = Scorer(net)
    for k in range(0, len(every), 65_536):
        scorer._add(every[k : k + 65_536])
    best, arg, passed = np.full(len(texts), -1.0), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for owner, p in scorer.of_ids([ids + 1 for ids in texts]):  # row 0 is no word's
        for i, start, n in zip(*np.unique(owner, return_index=True, return_counts=True), strict=True):
            k = int(p[start : start + n].argmax())
            if p[start + k] > best[i]:
                best[i], arg[i] = p[start + k], passed[i] + k
            passed[i] += n
    return arg.tolist()


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The bounded sample: documents that are labelled, not held out and not over SAMPLE_CHARS, drawn by hash of their id.

    Rows without a label, id or text are left out; an id with several labels counts as toxic if one of them is 1.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [
        known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(n)
        for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))
    ]
    some = F.broadcast(drawn[0].union(drawn[1]))  # SAMPLE_TOXIC + SAMPLE_CLEAN rows at most
    texts = docs.select("doc_id", "text").where(F.char_length("text") <= SAMPLE_CHARS).join(some, "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()
    return [(r["text"], int(r["toxic"])) for r in sorted(rows, key=lambda r: r["doc_id"])]


_LAST: list = [None, None]


def score_toxicity(df: DataFrame, net: Network, text: str = "text", drop: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Append score (double) and predicted (int: 1 from threshold up) to every row, from whole texts alone.

    Null texts and texts without words score 0. Equal texts score alike; rows are scored each for itself; an empty table gives
    an empty table; other columns pass through, and input columns named score or predicted are replaced.
    """
    shared, name = df.sparkSession.sparkContext.broadcast((net.at, net.P)), uuid.uuid4().hex

    def make():
        if _LAST[0] != name:
            own = Network.__new__(Network)
            own.at, own.P = shared.value
            _LAST[:] = [name, Scorer(own)]
        scorer = _LAST[1]

        def work(texts):
            scores = scorer.texts(texts)
            return [scores, [int(s >= threshold) for s in scores]]

        return work

    return map_texts(df, text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, drop)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels are learned from rows that are not held out."""
    docs = read(spark, sf_dir, "documents")
    net = train(training_rows(docs, read(spark, sf_dir, "labels")))
    return score_toxicity(docs.select("doc_id", held_out().alias("held_out"), "text"), net, drop=("text",))

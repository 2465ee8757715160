"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give base spans, which always stay. Base spans of a bounded sample
of documents label the windows on which the model is trained, in numpy, with
digits redrawn so that it learns shapes, not numbers. Each window that holds a
whole span is also trained on in disguise: the span in a form that the patterns
do not see ("me [at] home [dot] org", "442.555.2901", "10[.]1[.]2[.]3"), or a
number that is nobody's (a date, an amount, a version), which is no span. Texts
are then cut into overlapping windows, each is decoded, and each character takes
the tag of the decoded window in whose middle it lies most. What that adds away
from the base spans is kept if its mean marginal is at least SURE and it is what
its kind needs once the disguise is off (a card passes Luhn, an ip's parts are at
most 255).

Every kind needs a digit, an @ or a bracketed "at", so windows without any of
them begin no span and are not decoded.

Defined cases: a null text is the empty text, without spans. Repeated rows are
judged each for itself. With nothing to learn from there are base spans only.
Columns other than those named are carried along by `mask` and not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import util

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 32
#: Documents of the training sample (those with the smallest hash), its windows, and passes over them.
SAMPLE_DOCS, SAMPLE_WINDOWS, EPOCHS = 400, 600, 22
#: Least mean marginal of an added span.
SURE = 0.9
_EMBED, _HIDDEN, _CODES, _TAGS = 12, 16, 160, 9

# The patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TRIGGER = re.compile(r"[0-9@]|[\[(]\s?at\s?[\])]", re.I)
_AT = re.compile(r"\s*[\[(]\s?at\s?[\])]\s*|\s+@\s+", re.I)
_DOT = re.compile(r"\s*[\[(]\s?(?:dot|\.)\s?[\])]\s*|\s+\.\s+", re.I)


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(int(c) * 2 - 9 * (c > "4") for c in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start. Long runs cost one pass: an address is grown from its @."""
    if not _TRIGGER.search(text):
        return []
    out, last = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        i = m.start()
        while i > last and text[i - 1] in _LOCAL:
            i -= 1
        if i < m.start():
            out.append(("email", i, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        d = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def codes_of(text: str) -> np.ndarray:
    """ASCII characters have their own codes, all others share the rest."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(c < 128, c, 128 + c % (_CODES - 128))


def windows_of(text: str) -> list[int]:
    """Starts of the windows that hold the first character of a digit, an @ or a bracketed "at"."""
    out: list[int] = []
    for m in _TRIGGER.finditer(text):
        k = m.start() // STRIDE
        for j in (k - 1, k):
            if j >= 0 and j * STRIDE + WINDOW > m.start() and (not out or j * STRIDE > out[-1]):
                out.append(j * STRIDE)
    return out or []


def tags_of(n: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """0 outside; 1 + 2k begins kind k, 2 + 2k goes on. Where kinds overlap, the earlier listed one stays."""
    tag = np.zeros(n, np.int64)
    for kind, a, b in spans:
        if not tag[a:b].any():
            k = KINDS.index(kind)
            tag[a:b] = 2 + 2 * k
            tag[a] = 1 + 2 * k
    return tag


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


class Tagger:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        d = _EMBED + _HIDDEN
        init = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"emb": r.normal(0, 0.5, (_CODES, _EMBED)), "out": init(2 * _HIDDEN, _TAGS), "bias": np.zeros(_TAGS), "trans": np.zeros((_TAGS, _TAGS))}
        for side in "fb":
            self.p["w" + side] = init(d, 4 * _HIDDEN)
            self.p["b" + side] = np.repeat([0.0, 1.0, 0.0, 0.0], _HIDDEN)
        # A tag that goes on must follow its own kind.
        self.banned = np.zeros((_TAGS, _TAGS), bool)
        for k in range(len(KINDS)):
            self.banned[:, 2 + 2 * k] = True
            self.banned[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = False

    def trans(self) -> np.ndarray:
        return np.where(self.banned, -1e4, self.p["trans"])

    def _lstm(self, x: np.ndarray, side: str):
        """Hidden states of x (time, batch, embedding) and what the way back needs."""
        w, b = self.p["w" + side], self.p["b" + side]
        n = x.shape[1]
        h, c = np.zeros((n, _HIDDEN)), np.zeros((n, _HIDDEN))
        hs, kept = [], []
        for t in range(len(x)):
            z = np.concatenate([x[t], h], 1)
            g = z @ w + b
            i, f, o = (_sigmoid(g[:, k * _HIDDEN : (k + 1) * _HIDDEN]) for k in range(3))
            u = np.tanh(g[:, 3 * _HIDDEN :])
            was, c = c, f * c + i * u
            tc = np.tanh(c)
            h = o * tc
            hs.append(h)
            kept.append((z, i, f, o, u, was, tc))
        return np.stack(hs), kept

    def _lstm_back(self, dh: np.ndarray, kept: list, side: str, grad: dict) -> np.ndarray:
        w = self.p["w" + side]
        dx = np.zeros((len(dh), dh.shape[1], _EMBED))
        nh, nc = np.zeros(dh.shape[1:]), np.zeros(dh.shape[1:])
        gw, gb = np.zeros_like(w), np.zeros(4 * _HIDDEN)
        for t in range(len(dh) - 1, -1, -1):
            z, i, f, o, u, was, tc = kept[t]
            d = dh[t] + nh
            dc = nc + d * o * (1 - tc * tc)
            dg = np.concatenate([dc * u * i * (1 - i), dc * was * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - u * u)], 1)
            gw += z.T @ dg
            gb += dg.sum(0)
            dz = dg @ w.T
            dx[t], nh, nc = dz[:, :_EMBED], dz[:, _EMBED:], dc * f
        grad["w" + side], grad["b" + side] = gw, gb
        return dx

    def emissions(self, codes: np.ndarray, keep: bool = False):
        """Tag scores (time, batch, tags) of windows (batch, time)."""
        x = self.p["emb"][codes.T]
        hf, kf = self._lstm(x, "f")
        hb, kb = self._lstm(x[::-1], "b")
        h = np.concatenate([hf, hb[::-1]], 2)
        e = h @ self.p["out"] + self.p["bias"]
        return (e, h, kf, kb) if keep else e

    def chain(self, e: np.ndarray, mask: np.ndarray):
        """Forward and backward log sums of the CRF; padding (at the end) leaves them as they are."""
        t, n, _ = e.shape
        tr = self.trans()
        start = np.where(np.isin(np.arange(_TAGS), np.arange(2, _TAGS, 2)), -1e4, 0.0)
        alpha, beta = np.zeros(e.shape), np.zeros(e.shape)
        alpha[0] = e[0] + start
        for k in range(1, t):
            alpha[k] = np.where(mask[k][:, None], _logsum(alpha[k - 1][:, :, None] + tr, 1) + e[k], alpha[k - 1])
        for k in range(t - 2, -1, -1):
            beta[k] = np.where(mask[k + 1][:, None], _logsum(tr + (e[k + 1] + beta[k + 1])[:, None, :], 2), beta[k + 1])
        return alpha, beta, _logsum(alpha[-1], 1), start

    def loss(self, codes: np.ndarray, tags: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the windows' tags, and its gradients."""
        m, y = mask.T, tags.T
        e, h, kf, kb = self.emissions(codes, True)
        alpha, beta, z, start = self.chain(e, m)
        t, n = y.shape
        tr = self.trans()
        rows = np.arange(n)
        score = e[0, rows, y[0]] + start[y[0]]
        for k in range(1, t):
            score += m[k] * (e[k, rows, y[k]] + tr[y[k - 1], y[k]])
        de = np.exp(alpha + beta - z[None, :, None]) * m[:, :, None]
        gt = np.zeros_like(tr)
        for k in range(1, t):
            pair = np.exp(alpha[k - 1][:, :, None] + tr + (e[k] + beta[k])[:, None, :] - z[:, None, None]) * m[k][:, None, None]
            gt += pair.sum(0)
            np.add.at(gt, (y[k - 1], y[k]), -m[k].astype(float))
        k, r = np.nonzero(m)
        de[k, r, y[k, r]] -= 1
        de /= n
        grad = {"trans": np.where(self.banned, 0, gt / n), "bias": de.sum((0, 1)), "out": np.einsum("tnh,tnk->hk", h, de)}
        dh = de @ self.p["out"].T
        dx = self._lstm_back(dh[:, :, :_HIDDEN], kf, "f", grad)
        dx += self._lstm_back(dh[::-1, :, _HIDDEN:], kb, "b", grad)[::-1]
        grad["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(grad["emb"], codes.T, dx)
        return float((z - score).mean()), grad

    def fit(self, codes: np.ndarray, tags: np.ndarray, mask: np.ndarray, epochs: int, rate: float = 0.02, batch: int = 100) -> None:
        r = np.random.default_rng(5)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(codes))
            for lo in range(0, len(order), batch):
                at = order[lo : lo + batch]
                _, g = self.loss(codes[at], tags[at], mask[at])
                step += 1
                for k, v in g.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.99 * m2[k] + 0.01 * v * v
                    self.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)

    def decode(self, codes: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of each window (batch, time), and the marginals of those tags."""
        m = mask.T
        e = self.emissions(codes)
        t, n, _ = e.shape
        tr = self.trans()
        start = np.where(np.isin(np.arange(_TAGS), np.arange(2, _TAGS, 2)), -1e4, 0.0)
        best, back = e[0] + start, np.zeros(e.shape, np.int64)
        for k in range(1, t):
            s = best[:, :, None] + tr
            back[k] = np.where(m[k][:, None], s.argmax(1), np.arange(_TAGS))
            best = np.where(m[k][:, None], s.max(1) + e[k], best)
        tag = np.zeros((t, n), np.int64)
        tag[-1] = best.argmax(1)
        rows = np.arange(n)
        for k in range(t - 1, 0, -1):
            tag[k - 1] = back[k][rows, tag[k]]
        sure = np.ones((t, n))
        some = np.flatnonzero((tag * m).any(0))
        if len(some):
            alpha, beta, z, _ = self.chain(e[:, some], m[:, some])
            marg = np.exp(alpha + beta - z[None, :, None])
            sure[:, some] = np.take_along_axis(marg, tag[:, some][:, :, None], 2)[:, :, 0]
        return (tag * m).T, sure.T


def _plausible(kind: str, piece: str) -> bool:
    digits = _NOT_DIGIT.sub("", piece)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+@[^\s@.]+(\.[^\s@.]+)+", _DOT.sub(".", _AT.sub("@", piece))))
    if kind == "ip":
        parts = _DOT.sub(".", piece).split(".")
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", x) and int(x) <= 255 for x in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 ./_-]", piece)
    return 9 <= len(digits) <= 15 and not re.search(r"[^0-9 ()./+-]", piece)


def disguised(kind: str, piece: str, r: np.random.Generator) -> str:
    """A base span in one of the forms that the patterns do not see."""
    pick = lambda *forms: forms[int(r.integers(len(forms)))]
    d = _NOT_DIGIT.sub("", piece)
    if kind == "email":
        name, _, host = piece.rpartition("@")
        at = pick(" @ ", "(at)", "[at]", " (at) ", " [at] ", "@")
        dot = pick("[.]", "(dot)", "[dot]", " [dot] ") if at == "@" else pick(".", ".", "[.]", "(dot)", "[dot]", " [dot] ")
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return piece.replace(".", pick("[.]", "(.)", "[dot]", " . "))
    if kind == "card":
        return pick(".", "/", "_", "  ", " - ").join(d[k : k + 4] for k in range(0, len(d), 4))
    sep = pick("-", ".", " ", "/")
    local = f"{d[-10:-7]}{sep}{d[-7:-4]}{sep}{d[-4:]}" if len(d) >= 10 else d
    return pick(piece[1:], "00" + piece[1:], f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}" if len(d) >= 10 else d, local, local)


def nobodys(r: np.random.Generator) -> str:
    """A date, an amount, a version, a number: what looks like personal data and is not."""
    n = [int(x) for x in r.integers(0, 10**9, 4)]
    forms = (
        f"{1900 + n[0] % 200}-{1 + n[1] % 12:02d}-{1 + n[2] % 28:02d}", f"{1 + n[2] % 28:02d}.{1 + n[1] % 12:02d}.{1900 + n[0] % 200}", f"{n[0] % 24:02d}:{n[1] % 60:02d}:{n[2] % 60:02d}",
        f"{n[0] % 1000},{n[1] % 1000:03d},{n[2] % 1000:03d}.{n[3] % 100:02d}", f"v{n[0] % 20}.{n[1] % 20}.{n[2] % 100}", str(n[0] % 10 ** (1 + n[1] % 8)), f"{n[0] % 1000}.{n[1]}", f"{n[0] % 100} @ {n[1] % 100}",
    )
    return forms[int(r.integers(len(forms)))]


def _drawn(text: str, r: np.random.Generator) -> str:
    """The text with its digits redrawn."""
    return re.sub("[0-9]", lambda _: str(r.integers(10)), text)


def examples(text: str, tags: np.ndarray, r: np.random.Generator) -> list[tuple[str, np.ndarray]]:
    """A window with its digits redrawn; if it holds a whole span, also with those disguised, or nobody's numbers in their place."""
    out = [(_drawn(text, r), tags)]
    edge = [i for i in range(len(tags)) if tags[i] % 2 == 1 or (i and tags[i] == 0 and tags[i - 1] != 0)]
    spans = [(i, next((j for j in edge if j > i), len(tags))) for i in edge if tags[i]]
    whole = [(i, j) for i, j in spans if i and j < len(tags)]
    if not whole:
        return out
    for hidden in (True, True, False):
        pieces, y, at = [], [], 0
        for i, j in whole:
            kind = (int(tags[i]) - 1) // 2
            new = _drawn(disguised(KINDS[kind], text[i:j], r), r) if hidden else nobodys(r)
            tag = np.full(len(new), 2 + 2 * kind if hidden else 0)
            if hidden:
                tag[0] = 1 + 2 * kind
            pieces += [_drawn(text[at:i], r), new]
            y += [tags[at:i], tag]
            at = j
        pieces.append(_drawn(text[at:], r))
        y.append(tags[at:])
        out.append(("".join(pieces)[:WINDOW], np.concatenate(y)[:WINDOW]))
    return out


def all_spans(texts: list[str], model: Tagger | None, batch: int = 256) -> list[tuple[list, list]]:
    """For each text its base spans and those that the model adds."""
    base = [base_spans(t) for t in texts]
    added: list[list] = [[] for _ in texts]
    if model is None:
        return list(zip(base, added, strict=True))
    todo = [(k, a) for k, t in enumerate(texts) for a in windows_of(t)]
    found: dict[int, list] = {}
    for lo in range(0, len(todo), batch):
        some = todo[lo : lo + batch]
        codes, mask = np.zeros((len(some), WINDOW), np.int64), np.zeros((len(some), WINDOW), bool)
        for i, (k, a) in enumerate(some):
            c = codes_of(texts[k][a : a + WINDOW])
            codes[i, : len(c)], mask[i, : len(c)] = c, True
        tag, sure = model.decode(codes, mask)
        for i, (k, a) in enumerate(some):
            if tag[i].any():
                found.setdefault(k, []).append((a, tag[i], sure[i], int(mask[i].sum())))
    for k, win in found.items():
        added[k] = _reconcile(texts[k], base[k], win)
    return list(zip(base, added, strict=True))


def _reconcile(text: str, base: list, win: list) -> list[tuple[str, int, int]]:
    """One tag for each character, that of the window whose middle is nearest; spans of them away from base spans."""
    near: dict[int, tuple[float, int, float]] = {}
    for a, tag, sure, n in win:
        for j in np.flatnonzero(tag[:n] >= 0).tolist():
            far = abs(j - (WINDOW - 1) / 2)
            if a + j not in near or far < near[a + j][0]:
                near[a + j] = far, int(tag[j]), float(sure[j])
    out, at = [], sorted(i for i, v in near.items() if v[1])
    i = 0
    while i < len(at):
        kind = (near[at[i]][1] - 1) // 2
        j = i + 1
        while j < len(at) and at[j] == at[j - 1] + 1 and near[at[j]][1] == 2 + 2 * kind:
            j += 1
        a, b = at[i], at[j - 1] + 1
        mean = sum(near[x][2] for x in at[i:j]) / (j - i)
        if mean >= SURE and _plausible(KINDS[kind], text[a:b]) and all(b <= c or a >= d for _, c, d in base):
            out.append((KINDS[kind], a, b))
        i = j
    return out


def fit(docs: DataFrame) -> Tagger | None:
    """Trained on windows of the SAMPLE_DOCS documents with a digit or @ whose ids have the smallest hash."""
    spark = docs.sparkSession
    some = docs.where(F.col("text").rlike("[0-9@]")).select("doc_id").where("doc_id is not null").distinct()
    ids = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    chosen = F.broadcast(spark.createDataFrame(ids.toPandas(), ids.schema))  # at most SAMPLE_DOCS rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in util.pieces(batches):
            out = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                spans = base_spans(t)
                tag = tags_of(len(t), spans)
                for a in windows_of(t):
                    y = tag[a : a + WINDOW].copy()
                    # A span that began before the window begins with it.
                    if len(y) and y[0] and y[0] % 2 == 0:
                        y[0] -= 1
                    out.append((hashlib.sha256(f"{i}:{a}".encode()).digest(), t[a : a + WINDOW], y.astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.binary())], names=["k", "w", "y"])

    util.small_batches(spark)
    rows = docs.select("doc_id", "text").join(chosen, "doc_id", "left_semi").mapInArrow(cut, "k binary, w string, y binary")
    rows = rows.dropDuplicates(["w"]).orderBy("k", "w").limit(SAMPLE_WINDOWS).collect()
    if not rows:
        return None
    r = np.random.default_rng(3)
    made = [e for x in rows for e in examples(x.w, np.frombuffer(bytes(x.y), np.uint8).astype(np.int64), r)]
    codes, tags, mask = np.zeros((len(made), WINDOW), np.int64), np.zeros((len(made), WINDOW), np.int64), np.zeros((len(made), WINDOW), bool)
    for i, (w, y) in enumerate(made):
        codes[i, : len(w)], tags[i, : len(w)], mask[i, : len(w)] = codes_of(w), y, True
    model = Tagger()
    model.fit(codes, tags, mask, EPOCHS)
    return model


def detect(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added of each row."""
    util.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    order = {k: i for i, k in enumerate(KINDS)}
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in util.pieces(batches):
            got = all_spans(b.column("text").to_pylist(), shared.value)
            cols = [b.column("doc_id"), *(pa.array([sum(s[0] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS)]
            cols += [pa.array([hashlib.sha256(join(base).encode()).hexdigest() for base, _ in got], pa.string()), pa.array([join(base + more) for base, more in got], pa.string()), pa.array([len(more) for _, more in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans replaced by their kind in brackets; those that overlap become one, of the kind that begins first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """docs with the spans in text replaced; n_chars, if it is there, follows the text."""
    util.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    n_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, old in util.slices(batches, at):
            text = [masked(t, base + more) for t, (base, more) in zip(old, all_spans(old, shared.value), strict=True)]
            if n_at is not None:
                n = [n if t == o else len(t) for t, o, n in zip(text, old, b.column(n_at).to_pylist(), strict=True)]
                b = b.set_column(n_at, b.schema.field(n_at), pa.array(n, b.schema.field(n_at).type))
            null = b.column(at).is_null().to_numpy(zero_copy_only=False)
            yield b.set_column(at, b.schema.field(at), pa.array(text, b.schema.field(at).type, mask=null))

    return docs.mapInArrow(run, docs.schema)

"""Personal data: fixed patterns, and spans that a character model adds.

The patterns give the base spans. The model is a bidirectional LSTM over characters with a CRF on top, trained in numpy on
windows around base spans of a bounded sample of documents, and on altered copies of them (a phone number without its
country code, a spaced e-mail address, a card number with dots). A document's regions are the characters near a digit, an
at-sign or a plus, since every kind holds one of these; each region is read in overlapping windows, their scores are blended by
distance from the window's edge, and one Viterbi pass decodes the whole region. A span that the model adds must hold a value of
its kind and touch no base span.

Null and empty texts have no spans. Offsets count code points. Repeated rows get equal results; an empty table gives an
empty result, and without any base span in the sample the model adds nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.llm.common import batched, rows_of, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]")

SAMPLE_DOCS, SAMPLE_WINDOWS = 20_000, 1_536
WINDOW, STRIDE, REACH = 64, 32, 16
EMBED, HIDDEN, BATCH, EPOCHS = 12, 20, 64, 10
TAGS = 1 + 2 * len(KINDS)  # outside, then first and further characters of each kind
OTHER, PAD = 128, 129


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An address starts as far left of its at-sign as characters of a name go, but not inside the one before."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def small_parts(ip: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in ip.split(".")))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in order."""
    found = [(s, 0, e) for s, e in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if small_parts(m.group())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(found)


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches within ``REACH`` characters of a digit, at-sign or plus."""
    out: list[list[int]] = []
    for m in re.finditer(r"[0-9@+]+", text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def codes(text: str) -> np.ndarray:
    found = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.minimum(found, OTHER)


class Tagger:
    """The network: embedding, an LSTM each way, a linear layer and CRF transitions. Arrays are (time, batch, ...)."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)

        def of(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN:2 * HIDDEN] = 1  # cells remember at first
        self.p = {
            "embed": of(PAD + 1, EMBED) * 4, "w0": of(EMBED + HIDDEN, 4 * HIDDEN), "b0": bias, "w1": of(EMBED + HIDDEN, 4 * HIDDEN),
            "b1": bias.copy(), "out": of(2 * HIDDEN, TAGS), "c": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32),
        }

    def _lstm(self, x: np.ndarray, side: int) -> tuple[np.ndarray, list]:
        w, b = self.p[f"w{side}"], self.p[f"b{side}"]
        steps, batch = x.shape[:2]
        h = c = np.zeros((batch, HIDDEN), np.float32)
        out, kept = np.zeros((steps, batch, HIDDEN), np.float32), [None] * steps
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            xh = np.concatenate([x[t], h], 1)
            a = xh @ w + b
            gates = 1 / (1 + np.exp(-np.clip(a[:, :3 * HIDDEN], -30, 30)))
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:], np.tanh(a[:, 3 * HIDDEN:])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            kept[t] = (xh, i, f, o, g, before, tc)
        return out, kept

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        e = self.p["embed"][x]
        (a, ka), (b, kb) = self._lstm(e, 0), self._lstm(e, 1)
        h = np.concatenate([a, b], 2)
        return h @ self.p["out"] + self.p["c"], (h, ka, kb)

    def _lstm_back(self, d: np.ndarray, kept: list, side: int, grads: dict) -> np.ndarray:
        w = self.p[f"w{side}"]
        steps, batch = d.shape[:2]
        dx = np.zeros((steps, batch, EMBED), np.float32)
        dh = dc = np.zeros((batch, HIDDEN), np.float32)
        gw, gb = np.zeros_like(w), np.zeros_like(self.p[f"b{side}"])
        for t in range(steps - 1, -1, -1) if side == 0 else range(steps):
            xh, i, f, o, g, before, tc = kept[t]
            dh = dh + d[t]
            dc = dc + dh * o * (1 - tc * tc)
            da = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            gw += xh.T @ da
            gb += da.sum(0)
            back = da @ w.T
            dx[t], dh, dc = back[:, :EMBED], back[:, EMBED:], dc * f
        grads[f"w{side}"], grads[f"b{side}"] = gw, gb
        return dx

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags ``y``, and its gradients."""
        em, (h, ka, kb) = self.emissions(x)
        steps, batch = x.shape
        move, rows = self.p["move"], np.arange(batch)
        alpha, beta = np.zeros_like(em), np.zeros_like(em)
        alpha[0] = em[0]
        for t in range(1, steps):
            s = alpha[t - 1][:, :, None] + move
            top = s.max(1)
            alpha[t] = em[t] + top + np.log(np.exp(s - top[:, None]).sum(1))
        for t in range(steps - 2, -1, -1):
            s = move + (em[t + 1] + beta[t + 1])[:, None, :]
            top = s.max(2)
            beta[t] = top + np.log(np.exp(s - top[:, :, None]).sum(2))
        top = alpha[-1].max(1)
        z = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        gold = em[np.arange(steps)[:, None], rows, y].sum(0) + move[y[:-1], y[1:]].sum(0)
        d = np.exp(alpha + beta - z[:, None])
        d[np.arange(steps)[:, None], rows, y] -= 1
        pairs = np.exp(alpha[:-1, :, :, None] + move + (em[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum((0, 1))
        np.subtract.at(pairs, (y[:-1].ravel(), y[1:].ravel()), 1)
        d /= batch
        grads = {"move": pairs / batch, "c": d.sum((0, 1)), "out": np.einsum("tbh,tbk->hk", h, d)}
        dh = d @ self.p["out"].T
        dx = self._lstm_back(dh[:, :, :HIDDEN], ka, 0, grads) + self._lstm_back(dh[:, :, HIDDEN:], kb, 1, grads)
        grads["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grads["embed"], x, dx)
        return float((z - gold).mean()), grads

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01) -> float:
        """Adam over shuffled batches; ``x`` and ``y`` are (windows, time). Returns the last epoch's mean loss."""
        rng = np.random.default_rng(5)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step, loss = 0, 0.0
        for epoch in range(epochs):
            order, losses = rng.permutation(len(x)), []
            for at in range(0, len(x), BATCH):
                pick = order[at:at + BATCH]
                one, grads = self.gradients(x[pick].T, y[pick].T)
                losses.append(one)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                for k, g in grads.items():
                    g = g * min(1.0, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    now = rate * (0.3 if epoch >= 0.7 * epochs else 1)
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
            loss = float(np.mean(losses))
        return loss

    def viterbi(self, em: np.ndarray) -> np.ndarray:
        """Best tags of one region, (time, tags)."""
        move, back, s = self.p["move"], np.zeros(em.shape, np.int8), em[0]
        for t in range(1, len(em)):
            every = s[:, None] + move
            back[t] = every.argmax(0)
            s = every.max(0) + em[t]
        tags = np.zeros(len(em), np.int64)
        tags[-1] = s.argmax()
        for t in range(len(em) - 1, 0, -1):
            tags[t - 1] = back[t, tags[t]]
        return tags

    def tag(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Tags of whole regions: overlapping windows, blended by their distance from the edge."""
        cuts = [(r, a) for r, p in enumerate(parts) for a in range(0, max(1, len(p) - STRIDE), STRIDE)]
        weight = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)
        total = [np.zeros((len(p), TAGS), np.float32) for p in parts]
        seen = [np.zeros(len(p), np.float32) for p in parts]
        for at in range(0, len(cuts), 512):
            some = cuts[at:at + 512]
            x = np.full((WINDOW, len(some)), PAD)
            for k, (r, a) in enumerate(some):
                piece = parts[r][a:a + WINDOW]
                x[:len(piece), k] = piece
            em, _ = self.emissions(x)
            for k, (r, a) in enumerate(some):
                n = min(WINDOW, len(parts[r]) - a)
                total[r][a:a + n] += em[:n, k] * weight[:n, None]
                seen[r][a:a + n] += weight[:n]
        return [self.viterbi(t / s[:, None]) for t, s in zip(total, seen, strict=True)]  # a region has a character at least


def plausible(kind: int, value: str) -> bool:
    """Whether an added span holds a value of its kind, spacing aside."""
    tight, digits = re.sub(r"\s+", "", value), NOT_DIGIT.sub("", value)
    if kind == 0:
        return "@" in tight and next(emails(tight), None) == (0, len(tight))
    if kind == 1:
        return bool(IP.fullmatch(tight)) and small_parts(tight)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9]+(?:[ ._-]{1,2}[0-9]+)*", value))
    return 10 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][ ().0-9-]*[0-9]", value)) and bool(re.search("[ ()-]", value))


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """Spans of some texts that the model adds; the regions of all texts are read together."""
    where = [(d, a, b) for d, t in enumerate(texts) for a, b in regions(t)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (d, a, _), tags in zip(where, tagger.tag([codes(texts[d][a:b]) for d, a, b in where]), strict=True):
        start, kind = -1, -1
        for i in np.flatnonzero(np.append(tags, 0) != np.append(0, tags)).tolist() if tags.any() else ():
            # Tags change here: a first character, a further one after it, or the end of a span.
            tag = int(tags[i]) if i < len(tags) else 0
            if kind >= 0 and tag != 2 + 2 * kind:
                s, e = a + start, a + i
                if plausible(kind, texts[d][s:e]) and not any(x < e and s < z for x, _, z in base[d]):
                    out[d].append((s, kind, e))
                kind = -1
            if tag % 2:
                start, kind = i, tag // 2
    return out


def _altered(value: str, kind: int, turn: int) -> str:
    if kind == 0:
        return value.replace("@", " @ ") if turn % 2 else value.replace("@", "@ ")
    if kind == 2:
        digits = NOT_DIGIT.sub("", value)
        return "._"[turn % 2].join(digits[i:i + 4] for i in range(0, len(digits), 4))
    if kind == 3:
        return re.sub(r"^\+[0-9]{1,3}[ -]?", "", value)
    return value


def examples(text: str) -> Iterator[tuple[str, str]]:
    """Windows of a text with a tag digit for each character: as they are, and with altered spans."""
    base = base_spans(text)
    for a, b in regions(text):
        inside = [(s, k, e) for s, k, e in base if a <= s and e <= b]
        kept, edge = [], a
        for s, k, e in inside:
            if s >= edge:
                kept.append((s, k, e))
                edge = e
        for turn in range(3 if kept else 1):
            chars, tags, at = "", "", a
            for s, k, e in kept:
                value = text[s:e] if turn == 0 else _altered(text[s:e], k, turn)
                chars += text[at:s] + value
                tags += "0" * (s - at) + (str(1 + 2 * k) + str(2 + 2 * k) * (len(value) - 1) if value else "")
                at = e
            chars, tags = chars + text[at:b], tags + "0" * (b - at)
            for i in range(0, max(1, len(chars) - STRIDE), STRIDE):
                yield chars[i:i + WINDOW], tags[i:i + WINDOW]


_example_schema = pa.schema([("chars", pa.string()), ("tags", pa.string())])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS) -> dict | None:
    """Parameters of a tagger; None if the sample has no labelled span. Reads about ``sample_docs`` rows."""
    share = sample_docs / max(1, docs.count())
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if share < 1:
        chosen = chosen.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(21)), 11) / float(1 << 53) < share)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched((x for (t,) in rows_of(batches, "text") for x in examples(t or "")), _example_schema)

    every = chosen.select("text").mapInArrow(cut, "chars string, tags string").distinct()
    first = F.xxhash64("chars", F.lit(22))
    marked = F.col("tags").rlike("[1-9]")
    # A bounded number of windows, chosen by a hash; spans are rare, so they get most of the places.
    rows = every.where(marked).orderBy(first, "chars", "tags").limit(windows * 3 // 4).collect()
    if not rows:
        return None
    rows += every.where(~marked).orderBy(first, "chars", "tags").limit(windows // 4).collect()
    x, y = np.full((len(rows), WINDOW), PAD), np.zeros((len(rows), WINDOW), np.int64)
    for i, r in enumerate(rows):
        x[i, :len(r["chars"])] = codes(r["chars"])
        y[i, :len(r["tags"])] = [int(t) for t in r["tags"]]
    tagger = Tagger()
    tagger.fit(x, y)
    return tagger.p


def tagger_from(params: dict | None) -> Tagger | None:
    if params is None:
        return None
    tagger = Tagger()
    tagger.p = params
    return tagger


def all_spans(texts: list[str], tagger: Tagger | None) -> Iterator[tuple[list, list]]:
    """Base spans, and all spans in order, of each text."""
    base = [base_spans(t) for t in texts]
    more = added_spans(texts, base, tagger) if tagger else [[] for _ in texts]
    return ((b, sorted(b + m)) for b, m in zip(base, more, strict=True))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def grouped(rows: Iterator[tuple], size: int = 512, chars: int = 1 << 22) -> Iterator[list[tuple]]:
    """Rows in lists of bounded length; the text comes last in a row."""
    held, held_chars = [], 0
    for row in rows:
        held.append(row)
        held_chars += len(row[-1] or "")
        if len(held) >= size or held_chars >= chars:
            yield held
            held, held_chars = [], 0
    if held:
        yield held


_span_schema = pa.schema([
    ("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()),
])


def find_private(docs: DataFrame, params: dict | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = tagger_from(params)

        def rows() -> Iterator[tuple]:
            for some in grouped(rows_of(batches, "doc_id", "text")):
                for (doc_id, _), (base, spans) in zip(some, all_spans([t or "" for _, t in some], tagger), strict=True):
                    n = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
                    yield doc_id, *n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)

        yield from batched(rows(), _span_schema)

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def hidden(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in angle brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, params: dict | None) -> DataFrame:
    """All rows and columns, with spans in ``text`` replaced; null texts stay null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = tagger_from(params)
        for batch in batches:
            i = batch.schema.get_field_index("text")
            texts = []
            for some in grouped((x.as_py(),) for x in batch.column(i)):
                found = all_spans([t or "" for (t,) in some], tagger)
                texts += [t and hidden(t, spans) for (t,), (_, spans) in zip(some, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, f.type) if k == i else batch.column(k) for k, f in enumerate(batch.schema)], schema=batch.schema,
            )

    return docs.mapInArrow(run, docs.schema)


def op7_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_private(docs, train(docs))

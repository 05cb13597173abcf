"""Language of documents and of the segments of mixed ones (problem 1).

Averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy on
a bounded sample of labelled documents; probabilities are tempered on held-out sentences, and sentences below
the threshold take the language of their neighbours in a Viterbi pass. Rejection is calibrated apart from the
probabilities, which are high for unknown languages too: a segment whose n-grams its language has seen to a lesser
share than nearly all held-out sentences is of no known language, "und".

Defined results: null and empty texts, and texts without letters, give one segment with language "" and
confidence 0 (and are no case of p1_found); repeated rows each get their own segments; texts of any length
are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LANGS, spread

#: The training sample: at most so many labelled documents of each language, chosen by hash of doc_id.
TRAIN_DOCS = 160
BUCKETS = 1 << 16
DIM = 16
EPOCHS = 6
NGRAMS = (1, 2, 3, 4)
#: n-grams seen in training are marked for each language in so many places, bound whatever the corpus.
KNOWN = 1 << 22
#: Share of held-out sentences that may fall below the rejection floor of their language, and how far below it a segment
#: must be to be rejected; few n-grams tell less, by the spread of a share of so many, and very few nothing.
REJECTED, MARGIN, LEAST_GRAMS = 0.002, 0.1, 20
UNKNOWN = "und"
#: Held-out precision that the rejection threshold must reach.
PRECISION = 0.998
SWITCH = 3.5
#: Pieces with fewer characters (wide ones count three times) say less about their language: headings, broken lines.
FULL_SIZE = 55

_UNIT = re.compile(r"(?<=[.!?…])[”»“\"’)\]]*\s+|(?<=[。！？…])[”」』）]*(?=[^”」』）])|\r?\n+(?![^\S\n]*[a-zß-öø-ÿš-žа-яё])")
_GLOSS = re.compile(r"（[^（）]{0,80}）|\([^()]{0,80}\)|\[[^\[\]]{0,80}\]")
_RUN = re.compile(r"[぀-ヿ㐀-鿿ー々]+|[A-Za-zÀ-ɏ]+|[Ѐ-ӿ]+")
_SPACE = re.compile(r"[\W\d_]+")


#: A piece with fewer letters than this is no sentence of its own; it is joined to its neighbour in the same script.
SHORT = {"l": 14, "r": 14, "c": 5}


def _script(ch: str) -> str:
    return "c" if ch > "\u3000" else "r" if ch >= "\u0400" else "l"


def units(text: str) -> list[str]:
    """Pieces that are in one language each: sentences, and where two scripts meet at length, their runs."""
    out: list[str] = []
    held, held_kind = "", ""
    last_kind = ""
    for piece in _UNIT.split(text):
        if not piece or not piece.strip():
            continue
        bare = _GLOSS.sub(" ", piece)
        runs = list(_RUN.finditer(bare))
        if not runs:
            continue
        kinds = [_script(m[0][0]) for m in runs]
        if len(set(kinds)) > 1:
            parts = _by_script(bare, runs, kinds)
            kind = ""
        else:
            parts, kind = [bare], kinds[0]
        if len(parts) == 1 and kind and sum(len(m[0]) for m in runs) < SHORT[kind] and (not held or held_kind == kind):
            held, held_kind = f"{held} {bare}", kind
            continue
        if held:
            if kind in ("", held_kind) or not out:
                parts[0] = f"{held} {parts[0]}"
            elif last_kind in ("", held_kind):
                out[-1] = f"{out[-1]} {held}"
            held = ""
        out.extend(parts)
        last_kind = kind
    if held:
        if out and last_kind in ("", held_kind):
            out[-1] = f"{out[-1]} {held}"
        elif not out:
            out.append(held)
    return out


def _by_script(text: str, runs: list, kinds: list) -> list[str]:
    blocks: list[list] = []  # kind, from, to, letters, words
    for m, k in zip(runs, kinds, strict=True):
        if blocks and blocks[-1][0] == k:
            blocks[-1][2] = m.end()
            blocks[-1][3] += len(m[0])
            blocks[-1][4] += 1
        else:
            blocks.append([k, m.start(), m.end(), len(m[0]), 1])
    long = [b for b in blocks if (b[3] >= 7 if b[0] == "c" else b[4] >= 4 and b[3] >= 14)]
    if len({b[0] for b in long}) < 2:
        return [text]
    out, start, kind = [], 0, long[0][0]
    for b in long[1:]:
        if b[0] != kind:
            out.append(text[start:b[1]])
            start, kind = b[1], b[0]
    out.append(text[start:])
    return out


def features(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashed n-gram ids, first position of each piece's ids, number of ids of each piece; the longer n-grams' places in
    the table of known ones, and whose they are)."""
    joined = "\0".join(" " + _SPACE.sub(" ", p.lower()).strip() + " " for p in pieces) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    owner = np.cumsum(cp == 0) - (cp == 0)
    wide = cp >= 0x3000
    ids, own, marks, whose = [], [], [], []
    acc = np.zeros(len(cp), np.uint32)
    for n in NGRAMS:
        size = len(cp) - n + 1
        if size <= 0:
            break
        acc = acc[:size] * np.uint32(0x01000193) + cp[n - 1:] + np.uint32(n)
        ok = np.ones(size, bool)
        for k in range(n):
            ok &= cp[k:k + size] != 0
        if n > 2:
            ok &= ~wide[:size]
        h = acc[ok]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        ids.append((h % np.uint32(BUCKETS)).astype(np.int32))
        own.append(owner[:size][ok])
        if n >= 2:
            long = np.ones(len(h), bool) if n > 2 else wide[:size][ok]
            marks.append(((h[long] * np.uint32(0x9E3779B1)) >> np.uint32(10)).astype(np.int32))
            whose.append(own[-1][long])
    ids_all, own_all = np.concatenate(ids), np.concatenate(own)
    order = np.argsort(own_all, kind="stable")
    counts = np.bincount(own_all, minlength=len(pieces))
    return ids_all[order], np.concatenate([[0], np.cumsum(counts)[:-1]]), counts, np.concatenate(marks), np.concatenate(whose)


_CJK_ANY = re.compile(r"[぀-ヿ㐀-鿿]")
_CYR_ANY = re.compile(r"[Ѐ-ӿ]")
_LAT_ANY = re.compile(r"[A-Za-zÀ-ɏ]")


def _allowed(pieces: list[str]) -> np.ndarray:
    """Next to nothing for languages none of whose letters stand in the piece."""
    out = np.full((len(pieces), len(LANGS)), 1e-9)
    for i, p in enumerate(pieces):
        if _CJK_ANY.search(p):
            out[i, [0, 5]] = 1
        if _LAT_ANY.search(p):
            out[i, 1:5] = 1
        if _CYR_ANY.search(p):
            out[i, 6] = 1
    return out


class Model:
    """Table of each bucket's share in the logits (embedding times output weights), bias, temperature, threshold; which
    n-grams each language has seen, one bit for each, and the floor of each language's share of them."""

    def __init__(self, table, bias, temperature, threshold, known=None, floor=None):
        self.table, self.bias, self.temperature, self.threshold = table, bias, temperature, threshold
        self.known = np.zeros(KNOWN, np.uint8) if known is None else known
        self.floor = np.zeros(len(LANGS)) if floor is None else floor

    def judge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probabilities, n-grams, n-grams that the most probable language has seen) of each piece."""
        parts, seen, sizes = [], [], []
        for k in range(0, len(pieces), 2000):
            part = pieces[k:k + 2000]
            ids, first, counts, marks, whose = features(part)
            sums = np.add.reduceat(self.table[ids], np.minimum(first, max(len(ids) - 1, 0)), axis=0)
            sums[counts == 0] = 0
            logits = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits) * _allowed(part)
            p /= p.sum(1, keepdims=True)
            parts.append(p)
            bit = (self.known[marks] >> p.argmax(1).astype(np.uint8)[whose]) & 1
            sizes.append(np.bincount(whose, minlength=len(part)))
            seen.append(np.bincount(whose, weights=bit, minlength=len(part)))
        if not parts:
            return np.zeros((0, len(LANGS))), np.zeros(0), np.zeros(0)
        return np.concatenate(parts), np.concatenate(sizes), np.concatenate(seen)

    def proba(self, pieces: list[str]) -> np.ndarray:
        return self.judge(pieces)[0]

    def rejects(self, lang: int, size: float, seen: float) -> bool:
        """Whether a segment's share of n-grams that its language has seen is too low for any text in it."""
        return size >= LEAST_GRAMS and seen / size + MARGIN + 0.5 / size ** 0.5 < self.floor[lang]


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fits embeddings and output weights on the texts' sentences; a fifth of the texts calibrates."""
    pieces, ys, held = [], [], []
    fold = str.maketrans({c: b for b, cs in {"a": "àáâäãå", "e": "èéêë", "i": "ìíîï", "o": "òóôöõø", "u": "ùúûü", "c": "ç", "n": "ñ", "s": "š"}.items() for c in cs})
    for k, (text, label) in enumerate(zip(texts, labels, strict=True)):
        y = LANGS.index(label)
        for j, piece in enumerate(units(text)):
            if len(piece) < 6:
                continue
            pieces.append(piece.lower().translate(fold) if j % 4 == 1 else " ".join(piece.split()[:5]) if j % 4 == 3 and y not in (0, 5) else piece)
            ys.append(y)
            held.append(k % 5 == 0)
    rng = np.random.default_rng(seed)
    if not pieces:
        return Model(np.zeros((BUCKETS, len(LANGS)), np.float32), np.zeros(len(LANGS), np.float32), 1.0, 1.1)
    y = np.array(ys)
    held_out = np.array(held)
    ids, first, counts, marks, whose = features(pieces)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, len(LANGS))).astype(np.float32)
    bias = np.zeros(len(LANGS), np.float32)
    weight = 1 / np.maximum(np.bincount(y[~held_out], minlength=len(LANGS)), 1)
    weight = weight / weight.mean()
    pool = np.flatnonzero(~held_out & (counts > 0))
    steps, done, size = max(1, EPOCHS * (len(pool) // 64)), 0, 64
    for _ in range(EPOCHS):
        for at in range(0, len(pool), size):
            if at == 0:
                rng.shuffle(pool)
            rows = pool[at:at + size]
            rate = 2.0 * max(0.05, 1 - done / steps)
            done += 1
            flat = np.concatenate([ids[first[r]:first[r] + counts[r]] for r in rows])
            own = np.repeat(np.arange(len(rows)), counts[rows])
            starts = np.concatenate([[0], np.cumsum(counts[rows])[:-1]])
            mean = np.add.reduceat(emb[flat], starts, axis=0) / counts[rows][:, None]
            z = mean @ out + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[y[rows]][:, None] / len(rows)
            grad_mean = p @ out.T
            out -= rate * mean.T @ p
            bias -= rate * p.sum(0)
            step = (grad_mean / counts[rows][:, None] * (rate * 64)).astype(np.float32)[own]
            order = np.argsort(flat, kind="stable")
            ranked = flat[order]
            edges = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            emb[ranked[edges]] -= np.add.reduceat(step[order], edges, axis=0)
    known = np.zeros(KNOWN, np.uint8)
    learnt = ~held_out[whose]
    for k in range(len(LANGS)):
        known[marks[learnt & (y[whose] == k)]] |= np.uint8(1 << k)
    model = Model((emb @ out).astype(np.float32), bias, 1.0, 0.0, known)
    _calibrate(model, [p for p, h in zip(pieces, held, strict=True) if h], y[held_out])
    return model


def _calibrate(model: Model, pieces: list[str], y: np.ndarray) -> None:
    """Temperature by held-out likelihood, then the lowest threshold with the wanted precision."""
    if not pieces:
        return
    best = (np.inf, 1.0)
    for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0):
        model.temperature = t
        p = model.proba(pieces)
        loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-6)).mean()
        best = min(best, (loss, t))
    model.temperature = best[1]
    p, sizes, seen = model.judge(pieces)
    for k in range(len(LANGS)):
        mine = (y == k) & (p.argmax(1) == k) & (sizes >= 40)
        if mine.sum() >= 20:
            model.floor[k] = np.quantile(seen[mine] / sizes[mine], REJECTED)
    right, top = p.argmax(1) == y, p.max(1)
    order = np.argsort(-top)
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    model.threshold = float(top[order[good[-1]]]) if len(good) else 1.0
    model.held_out_accuracy = float(right.mean())


def segment(probs: np.ndarray, sizes: list[int], threshold: float) -> list[tuple[int, float, int, int]]:
    """(language, confidence, first unit, end) of each run of units, by Viterbi; units below the threshold carry little
    weight of their own."""
    weight = np.minimum(1, np.array(sizes) / FULL_SIZE) ** 2
    logp = np.log(np.maximum(probs, 1e-4)) * weight[:, None]
    logp[probs.max(1) < threshold] *= 0.3
    n, k = logp.shape
    score, back = logp[0].copy(), np.zeros((n, k), int)
    for i in range(1, n):
        top = int(score.argmax())
        stay, move = score, score[top] - SWITCH
        back[i] = np.where(stay >= move, np.arange(k), top)
        score = np.maximum(stay, move) + logp[i]
    path = [int(score.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    path.reverse()
    out: list[list] = []
    for i, c in enumerate(path):
        if out and out[-1][0] == c:
            out[-1][1] += probs[i, c] * sizes[i]
            out[-1][2] += sizes[i]
            out[-1][4] = i + 1
        else:
            out.append([c, probs[i, c] * sizes[i], sizes[i], i, i + 1])
    return [(c, s / max(w, 1), x, z) for c, s, w, x, z in out]


def training_sample(documents: DataFrame) -> tuple[list[str], list[str]]:
    """At most TRAIN_DOCS texts of each language, the same for the same documents, whatever their order."""
    labelled = documents.filter(F.col("lang").isin(*LANGS) & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.3 * TRAIN_DOCS / n))])
    mark = F.abs(F.xxhash64("doc_id")) % 1_000_000
    picked = labelled.filter(mark < share[F.col("lang")] * 1_000_000).select("lang", "text", mark.alias("m"), "doc_id").collect()
    texts, labels, seen = [], [], {}
    for r in sorted(picked, key=lambda r: (r["m"], r["doc_id"])):
        if seen.setdefault(r["lang"], 0) < TRAIN_DOCS:
            seen[r["lang"]] += 1
            texts.append(r["text"])
            labels.append(r["lang"])
    return texts, labels


SEGMENTS = "tab string, row_id bigint, seg_idx int, lang string, confidence double, label string, segments int"


def segments(rows: DataFrame, model: Model) -> DataFrame:
    """Segments of rows (tab, row_id, text, label)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            tabs, ids, texts, labels = (batch.column(c).to_pylist() for c in ("tab", "row_id", "text", "label"))
            pieces, spans = [], []
            for text in texts:
                own = units(text) if text else []
                spans.append((len(pieces), len(pieces) + len(own)))
                pieces.extend(own)
            probs, grams, seen = model.judge(pieces)
            top = probs.argmax(1) if len(pieces) else np.zeros(0, int)
            rows_out = [[] for _ in range(7)]
            for tab, rid, label, (a, b) in zip(tabs, ids, labels, spans, strict=True):
                if a == b:
                    segs = [("", 0.0)]
                else:
                    sizes = [len(p) * (3 if _CJK_ANY.search(p) else 1) for p in pieces[a:b]]
                    same = (top[a:b] == top[a]).all()
                    runs = [(int(top[a]), float(np.average(probs[a:b, top[a]], weights=sizes)), 0, b - a)] if same else segment(probs[a:b], sizes, model.threshold)
                    segs = []
                    for c, conf, x, z in runs:
                        own = top[a + x:a + z] == c
                        unknown = model.rejects(c, float(grams[a + x:a + z][own].sum()), float(seen[a + x:a + z][own].sum()))
                        segs.append((UNKNOWN if unknown else LANGS[c], conf))
                for i, (c, conf) in enumerate(segs):
                    for col, v in zip(rows_out, (tab, rid, i, c, float(conf), label, len(segs)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(rows_out, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.int32()), strict=True)],
                ["tab", "row_id", "seg_idx", "lang", "confidence", "label", "segments"],
            )

    return rows.mapInArrow(run, SEGMENTS)


def fit(documents: DataFrame) -> Model:
    return train(*training_sample(documents))


def all_segments(documents: DataFrame, wiki_chunk: DataFrame, sentences: DataFrame) -> DataFrame:
    """Every text of both tables with its segments."""
    model = fit(documents)
    chunks = wiki_chunk.select(F.lit("wiki_chunk").alias("tab"), F.col("chunk_id").alias("row_id"), "text", F.col("lang").alias("label"))
    rows = sentences.select(F.lit("sentences").alias("tab"), "row_id", F.col("sentence").alias("text"), F.lit(None).cast("string").alias("label"))
    return segments(spread(chunks.unionByName(rows)), model)


def found(documents: DataFrame, wiki_chunk: DataFrame, sentences: DataFrame) -> DataFrame:
    """The cases: chunks with a label that isn't their text's language, and texts of several languages. Segments of no
    known language have none of the seven codes, so they aren't among the rows."""
    every = all_segments(documents, wiki_chunk, sentences)
    code = F.lower(F.element_at(F.split(F.trim(F.coalesce("label", F.lit(""))), "[-_]"), 1))
    case = (F.col("segments") > 1) | ((F.col("tab") == "wiki_chunk") & (code != F.col("lang")))
    return every.filter(case & ~F.col("lang").isin("", UNKNOWN)).select("tab", "row_id", "seg_idx", "lang")

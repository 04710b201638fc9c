"""Licence notices in text: a trained paragraph classifier, confirmed by templates.

A paragraph is the text between two blank lines.  Windows of 40 words of
paragraphs, and lines by themselves, are scored by a multinomial logistic
regression over the one-, two- and three-word sequences that occur in licence
templates.  It is trained on worn copies of the templates, on notices of
licences outside the listed families (the class ``unknown``) and on ordinary
paragraphs of a bounded sample.  Probabilities are calibrated by temperature on
material held out from training.  Every likely window is looked at: templates
found in it confirm a named family, and what else the probabilities call a
notice is ``unknown``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm import words as W
from lanternfish.llm.license_templates import GRANTS, LICENCES, ORDINARY, TEMPLATES, UNLISTED

NONE, UNKNOWN = "none", "unknown"
STRIDE = 20
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_WORD = re.compile(r"[a-z0-9]+")
#: Words as ``words.split`` counts them, in the text itself.
_PLACED = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")
_BLANK_LINE = re.compile(r"\n[^\S\n]*(?=\n)")
_LICENCE = re.compile(r"licen[sc]|copyright|public domain", re.IGNORECASE)


@dataclass(frozen=True)
class Classifier:
    """Sorted feature hashes, weights (features by classes), biases and the calibration.

    The classes are the families, then ``unknown``, then ``none``.
    """

    families: list[str]
    features: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def _grams(keys: np.ndarray, paragraph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of one to three words, number of the first word) within paragraphs."""
    codes, at = [], []
    code = np.zeros(len(keys), dtype=np.uint64)
    for j in range(3):
        n = max(len(keys) - j, 0)
        code = code[:n] + keys[j : j + n] * _STEP[j]
        inside = paragraph[:n] == paragraph[j : j + n]
        codes.append(W.mixed(code + np.uint64(j))[inside])
        at.append(np.flatnonzero(inside))
    return np.concatenate(codes), np.concatenate(at)


def _block_scores(group, model_features: np.ndarray, weights: np.ndarray):
    """(paragraph of each block, its scores): blocks are ``STRIDE`` words of a paragraph."""
    raw, starts, ends, which = W.split(group)
    size = weights.shape[1]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros((0, size))
    keys = W.hashes(raw, starts, ends)
    first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
    lengths = np.diff(np.append(first, len(which)))
    nth = np.arange(len(which)) - np.repeat(first, lengths)
    block = np.cumsum(nth % STRIDE == 0) - 1
    owner = which[np.flatnonzero(nth % STRIDE == 0)]
    codes, at = _grams(keys, which)
    spot = np.minimum(np.searchsorted(model_features, codes), len(model_features) - 1)
    hit = model_features[spot] == codes
    rows, where = weights[spot[hit]], block[at[hit]]
    return owner, np.stack([np.bincount(where, rows[:, k], minlength=len(owner)) for k in range(size)], axis=1)


def _windows(owner: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Scores of each block together with the next one of its paragraph."""
    out = scores.copy()
    if len(owner) > 1:
        same = owner[1:] == owner[:-1]
        out[:-1][same] += scores[1:][same]
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _sequences(words: list[str]) -> set[tuple[str, ...]]:
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


_SEQUENCES = {family: [_sequences(_tokens(t)) for t in ts] for family, ts in TEMPLATES.items()}


#: Of each template the family and its triples' places; each triple with the numbers of the templates that hold it.
_LISTED: list[tuple[str, dict]] = []
_HOLDERS: dict[tuple[str, ...], list[int]] = {}
for _family, _texts in TEMPLATES.items():
    for _words in map(_tokens, _texts):
        _spots: dict[tuple[str, ...], int] = {}
        for _i in range(len(_words) - 2):
            _spots.setdefault(tuple(_words[_i : _i + 3]), _i)
        for _triple in _spots:
            _HOLDERS.setdefault(_triple, []).append(len(_LISTED))
        _LISTED.append((_family, _spots))


def template_similarity(paragraph: str, family: str) -> float:
    """Share of a template's word triples that the paragraph has, for the best template."""
    words = _tokens(paragraph)
    have = {tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return max(len(t & have) / len(t) for t in _SEQUENCES[family])


def _worn(rng: np.random.Generator, template: str, filler: list[str]) -> str:
    """A template with words lost, changed or cut off, at times amid other words."""
    words = template.split()
    if len(words) > 12 and rng.random() < 0.4:
        a = int(rng.integers(0, len(words) // 2))
        words = words[a : a + int(rng.integers(10, len(words) + 1))]
    wear = rng.choice([0.0, 0.0, 0.05, 0.1])
    words = [w for w in words if rng.random() >= wear]
    if filler and rng.random() < 0.3:
        extra = [filler[int(rng.integers(len(filler)))] for _ in range(int(rng.integers(1, 20)))]
        words = extra + words if rng.random() < 0.5 else words + extra
    return " ".join(words)


def train(paragraphs: list[str], copies: int = 60, rounds: int = 150, seed: int = 5) -> Classifier:
    """Fit on worn templates and on ordinary paragraphs (none of which may be a notice)."""
    rng = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    ordinary = [p for p in paragraphs if _tokens(p) and not _LICENCE.search(p) and max(template_similarity(p, f) for f in families) < 0.4]
    filler = [w for p in ordinary[:200] for w in p.split()]
    examples, labels = [], []
    for y, family in enumerate(families):
        for template in TEMPLATES[family]:
            examples += [template, *(_worn(rng, template, filler) for _ in range(copies))]
            labels += [y] * (copies + 1)
    for template in UNLISTED:
        examples += [template, *(_worn(rng, template, filler) for _ in range(copies // 4))]
        labels += [len(families)] * (copies // 4 + 1)
    # Names are no features, so that any licence's does.
    named = [f"{a} {'x' * int(rng.integers(3, 12))}{i} {b}" for i, (a, b) in enumerate((a, b) for a in GRANTS for b in LICENCES)]
    examples += named
    labels += [len(families)] * len(named)
    ordinary += [x for x in ORDINARY for _ in range(5)]
    ordinary += [" ".join(rng.permutation(t.split())[:5]) for ts in TEMPLATES.values() for t in ts for _ in range(20)]
    examples += ordinary
    labels += [len(families) + 1] * len(ordinary)
    y, size = np.array(labels), len(families) + 2
    templates = [(i, t) for i, t in enumerate([*(t for ts in TEMPLATES.values() for t in ts), *UNLISTED, *GRANTS, *LICENCES])]
    raw, starts, ends, which = W.split(templates)
    features = np.unique(_grams(W.hashes(raw, starts, ends), which)[0])
    # Counts of the features in each example, as (example, feature) pairs.
    raw, starts, ends, which = W.split(list(enumerate(examples)))
    codes, at = _grams(W.hashes(raw, starts, ends), which)
    spot = np.minimum(np.searchsorted(features, codes), len(features) - 1)
    hit = features[spot] == codes
    row, col = which[at[hit]], spot[hit]
    x = np.zeros((len(examples), len(features)), dtype=np.float32)
    np.add.at(x, (row, col), 1)
    held = rng.random(len(y)) < 0.25
    target = np.eye(size, dtype=np.float32)[y]
    # Each class weighs the same, so that a rare family is learned as well as ordinary text.
    weight = (1.0 / np.bincount(y, minlength=size).clip(1))[y].astype(np.float32)
    weight[held] = 0
    weight /= weight.sum()
    w, b = np.zeros((len(features), size), np.float32), np.zeros(size, np.float32)
    sw, sb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(rounds):
        gap = (target - _softmax(x @ w + b)) * weight[:, None]
        gw, gb = x.T @ gap - 1e-5 * w, gap.sum(axis=0)
        sw += gw * gw
        sb += gb * gb
        w += 0.2 * gw / np.sqrt(sw)
        b += 0.2 * gb / np.sqrt(sb)
    logits = x[held] @ w + b

    def loss(t: float) -> float:
        return float(-np.log(_softmax(logits / t)[np.arange(len(logits)), y[held]] + 1e-12).mean())

    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0), key=loss)
    p = _softmax(logits / temperature)
    noise = p[y[held] == size - 1, :-1].max(axis=1) if (y[held] == size - 1).any() else np.zeros(1)
    threshold = float(np.clip(np.quantile(noise, 0.999), 0.5, 0.95))
    return Classifier(families, features, w.astype(np.float64), b.astype(np.float64), temperature, threshold)


def training_paragraphs(docs: DataFrame, id_col: str, text_col: str, sample_docs: int, sample_chars: int) -> list[str]:
    """Paragraphs of at most ``sample_docs`` documents, picked by hash of id and text; training only.

    Of each document a window of ``sample_chars`` characters somewhere in the
    text is used.  A share of the rows by hash is looked at, some times as many
    as are wanted in all, so what reaches the driver does not grow with the table.
    """
    text = F.col(text_col)
    usable = docs.where(text.isNotNull())
    share = min(1.0, 8 * sample_docs / max(usable.count(), 1))
    h = F.xxhash64(F.col(id_col), text)
    begin = (F.pmod(F.xxhash64(h), F.greatest(F.length(text) - sample_chars, F.lit(0)) + 1) + 1).cast("int")
    rows = (
        usable.select(h.alias("h"), text.substr(begin, F.lit(sample_chars)).alias("t"))
        .where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).orderBy("h", "t").limit(sample_docs).collect()
    )
    return [p for r in rows for p in r["t"].split("\n") if p.strip()]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 300, sample_chars: int = 2000) -> Classifier:
    """A classifier whose ordinary paragraphs come from a bounded sample of ``docs``."""
    return train(training_paragraphs(docs, id_col, text_col, sample_docs, sample_chars))


def paragraphs(text: str):
    """(start, paragraph) between blank lines, in code points; those without text are left out."""
    at = 0
    for gap in _BLANK_LINE.finditer(text):
        if text[at : gap.start()].strip():
            yield at, text[at : gap.start()]
        at = gap.end()
    if text[at:].strip():
        yield at, text[at:]


def _probabilities(pieces: list[str], model: Classifier) -> list[np.ndarray]:
    """For each piece the class probabilities of its windows, one row a block."""
    owner, scores = _block_scores(list(enumerate(pieces)), model.features, model.weights)
    p = _softmax((_windows(owner, scores) + model.bias) / model.temperature)
    cuts = np.searchsorted(owner, np.arange(len(pieces) + 1))
    return [p[a:b] for a, b in zip(cuts, cuts[1:])]


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges with those that touch made one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _matches(words: list[str], confirm: float):
    """(template, similarity, first word, end, words hit) of each place that has enough of a template's triples.

    A place is a chain of triples in the template's order, none further from the
    last than the template is long.  Jumps cost, so that a stray triple isn't added.
    """
    places: dict[int, list[int]] = {}
    for i in range(len(words) - 2):
        for t in _HOLDERS.get(tuple(words[i : i + 3]), ()):
            places.setdefault(t, []).append(i)
    for t, at in places.items():
        spots = _LISTED[t][1]
        if len(at) < confirm * len(spots):
            continue
        reach, cost = max(len(spots), 8), min(2.0, 0.15 * len(spots))
        q = [spots[tuple(words[i : i + 3])] for i in at]
        free = list(range(len(at)))
        while len(free) >= confirm * len(spots):
            value, back = {}, {}
            for n, x in enumerate(free):
                value[x], back[x] = 1.0, -1
                for y in reversed(free[max(0, n - reach - 2) : n]):
                    if at[x] - at[y] > reach + 2:
                        break
                    if q[y] < q[x]:
                        v = value[y] + 1 - cost * (abs(at[x] - at[y] - q[x] + q[y]) > 3)
                        if v > value[x]:
                            value[x], back[x] = v, y
            chains, used = [], set()
            for x in sorted(free, key=lambda x: -value[x]):
                chain = []
                while x >= 0 and x not in used:
                    chain.append(x)
                    x = back[x]
                if x >= 0 or not chain:
                    continue
                if len(chain) < confirm * len(spots):
                    break
                used.update(chain)
                chains.append(chain[::-1])
            for chain in chains:
                run = [at[x] for x in chain]
                yield t, len(run) / len(spots), run[0], run[-1] + 3, {j for i in run for j in (i, i + 1, i + 2)}
            if not chains:
                break
            free = [x for x in free if x not in used]


def _notable(piece: str, model: Classifier) -> tuple[int, int] | None:
    """(first, end) of the words of a piece whose features speak for a notice."""
    raw, starts, ends, which = W.split([(0, piece)])
    codes, at = _grams(W.hashes(raw, starts, ends), which)
    spot = np.minimum(np.searchsorted(model.features, codes), len(model.features) - 1)
    orders = np.repeat([1, 2, 3], [max(len(starts) - j, 0) for j in range(3)])
    speaks = (model.features[spot] == codes) & (model.weights[spot, -1] < 0) & (orders > 1)
    if not speaks.any():
        speaks = (model.features[spot] == codes) & (model.weights[spot, -1] < 0)
    return (int(at[speaks].min()), int((at + orders)[speaks].max())) if speaks.any() else None


def _findings(text: str, likely: list[tuple[int, int]], words: list[tuple[int, int]], model: Classifier, confirm: float) -> list[dict]:
    """The notices of a paragraph whose likely words are given as ranges of word numbers."""

    def chars(first: int, end: int) -> tuple[int, int]:
        """The words with the signs that touch them."""
        a, b = words[first][0], words[end - 1][1]
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        return a, b

    found: list[list] = []
    for a, b in _joined([(max(a - 2 * STRIDE, 0), min(b + 2 * STRIDE, len(words))) for a, b in likely]):
        cut = [text[s:e].lower() for s, e in words[a:b]]
        found += [[t, alike, a + s, a + e, {a + j for j in hit}] for t, alike, s, e, hit in _matches(cut, confirm)]
    # Each is judged by its own words; the larger goes first, and takes its words from the others.
    judged = []
    for (t, alike, s, e, hit), p in zip(found, _probabilities([text[words[s][0] : words[e - 1][1]] for _, _, s, e, _ in found], model) if found else []):
        own = p[p[:, :-1].max(axis=1).argmax()]
        top = own[: len(model.families)].argmax()
        sure = model.families[top] == _LISTED[t][0] and own[top] >= model.threshold
        if sure or 1 - own[-1] >= model.threshold:
            judged.append((not sure, -len(hit), -alike, s, e, _LISTED[t][0] if sure else UNKNOWN, float(own[top]), t, hit))
    taken: set[int] = set()
    kept: list[list] = []
    for _, _, alike, s, e, family, probability, t, hit in sorted(judged, key=lambda x: x[:6]):
        if 2 * len(hit & taken) <= len(hit):
            kept.append([s, e, family, probability, -alike, {t}])
            taken |= hit
    kept.sort(key=lambda x: x[:3])
    out: list[list] = []
    for x in kept:
        if out and out[-1][2] == x[2] and x[0] - out[-1][1] <= 3 and not out[-1][5] & x[5]:
            last = out[-1]
            out[-1] = [last[0], max(last[1], x[1]), x[2], max(last[3], x[3]), max(last[4], x[4]), last[5] | x[5]]
        else:
            out.append(x)
    # What is likely and not yet told is unknown, if it is a notice by itself.
    for s, e, *_ in out:
        taken |= set(range(s, e))
    rest: list[tuple[int, int]] = []
    for a, b in _joined(likely):
        free = [i for i in range(a, b) if i not in taken]
        cuts = [0, *(k for k in range(1, len(free)) if free[k] != free[k - 1] + 1), len(free)]
        rest += [(free[k], free[m - 1] + 1) for k, m in zip(cuts, cuts[1:]) if m > k]
    pieces = [text[words[a][0] : words[b - 1][1]] for a, b in rest]
    for (a, _), piece, p in zip(rest, pieces, _probabilities(pieces, model) if pieces else []):
        own = p[p[:, :-1].sum(axis=1).argmax()]
        place = _notable(piece, model)
        if 1 - own[-1] >= model.threshold and place and place[1] - place[0] >= 3:
            alike = max(template_similarity(piece, f) for f in model.families)
            out.append([a + place[0], a + place[1], UNKNOWN, float(own[:-1].max()), alike, set()])
    told = [(*chars(s, e), family, probability, alike) for s, e, family, probability, alike, _ in out]
    return [dict(zip(("family", "start", "end", "probability", "similarity"), (f, s, e, p, float(x)))) for s, e, f, p, x in sorted(told)]


def find(texts: list[str | None], model: Classifier, confirm: float = 0.6) -> list[list[dict]]:
    """The notices of each text: family, start, end, probability, similarity."""
    out: list[list[dict]] = [[] for _ in texts]
    group: list[tuple[int, int, str]] = []
    held = 0

    def judge():
        parts = [p for _, _, p in group]
        lines = [(k, m.start(), m.group()) for k, p in enumerate(parts) if "\n" in p for m in re.finditer(r"[^\n]+", p)]
        likely: dict[int, list[tuple[int, int]]] = {}
        for k, p in enumerate(_probabilities(parts, model)):
            for i in np.flatnonzero(p[:, -1] < 0.5).tolist():
                likely.setdefault(k, []).append((i * STRIDE, (i + 2) * STRIDE))
        # A line by itself may be a notice that its neighbours hide.
        alone: dict[int, list[tuple[int, int]]] = {}
        for (k, at, line), p in zip(lines, _probabilities([x for _, _, x in lines], model) if lines else []):
            if (p[:, -1] < 0.5).any():
                alone.setdefault(k, []).append((at, at + len(line)))
        for k in sorted({*likely, *alone}):
            text_no, start, part = group[k]
            words = [m.span() for m in _PLACED.finditer(part)]
            begins = [a for a, _ in words]
            ranges = [(a, min(b, len(words))) for a, b in likely.get(k, [])]
            ranges += [(bisect_left(begins, a), bisect_left(begins, b)) for a, b in alone.get(k, [])]
            for x in _findings(part, ranges, words, model, confirm):
                out[text_no].append({**x, "start": start + x["start"], "end": start + x["end"]})

    for i, text in enumerate(texts):
        for at, paragraph in paragraphs(text or ""):
            group.append((i, at, paragraph))
            held += len(paragraph)
            if held >= W.SLICE:
                judge()
                group, held = [], 0
    if group:
        judge()
    return out


FINDING = pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64()), ("similarity", pa.float64())])


def _scan(batches, model):
    for batch in batches:
        found = find(batch.column(1).to_pylist(), model)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(FINDING))], ["doc_id", "findings"])


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, findings array<struct<family, start, end, probability, similarity>>.

    Findings are in text order, with code-point offsets of the notices.
    Null and empty texts have none.  Repeated rows and null ids each give their
    row; of families with equal probability the first by name is taken.  An
    empty table gives an empty result; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, findings array<struct<family:string,start:bigint,end:bigint,probability:double,similarity:double>>"
    return slim.mapInArrow(lambda it: _scan(it, sent.value), schema)

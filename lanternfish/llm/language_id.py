"""Language identification by a linear-chain conditional random field over words.

Each word has features: its letter pairs and triples with its ends marked, its
first and last three letters, and its entry in a lexicon of frequent words.
Emission and transition weights are learned together by gradient ascent on the
conditional likelihood of training sequences, which are spliced from documents
of different languages so that switches occur in them.  Forward-backward gives
each word's posterior; a document's language has the largest share of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm import words as W

BITS = 17
UNDETERMINED = "und"
_SALT = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_SHIFT = np.uint64(64 - BITS)


@dataclass(frozen=True)
class Model:
    """Weights of a trained field; ``lexicon`` holds sorted word hashes."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray


def _spot(value: np.ndarray, salt: int) -> np.ndarray:
    return ((value + np.uint64(1)) * _SALT[salt] >> _SHIFT).astype(np.int64)


def _gram_ids(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the pair and of the triple that start at each byte."""
    b = np.where(W._IN_WORD[raw], raw, 0x20).astype(np.uint64)
    pair = b[:-1] << np.uint64(8) | b[1:]
    return _spot(pair, 0), _spot(pair[:-1] << np.uint64(8) | b[2:], 1)


def _word_ids(raw, starts, ends, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of prefix and suffix, and of the lexicon entry or -1."""
    b = np.where(W._IN_WORD[raw], raw, 0x20).astype(np.uint64)
    n = len(b) - 1
    affixes = []
    for salt, at in ((2, (0, 1, 2)), (3, (-1, -2, -3))):
        base = starts if salt == 2 else ends
        code = np.zeros(len(starts), dtype=np.uint64)
        for k in at:
            code = code << np.uint64(8) | b[np.clip(base + k, 0, n)]
        affixes.append(_spot(code, salt))
    keys = W.hashes(raw, starts, ends)
    at = np.minimum(np.searchsorted(lexicon, keys), max(len(lexicon) - 1, 0))
    known = lexicon[at] == keys if len(lexicon) else np.zeros(len(keys), bool)
    return affixes[0], affixes[1], np.where(known, _spot(keys, 4), -1)


def _emissions(group, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(scores of each lettered word, its text number)."""
    raw, starts, ends, which = W.split(group)
    lettered = np.add.reduceat(W.IN_LETTER[raw], starts) if len(starts) else starts
    # reduceat runs on to the next word, but what lies between has no letters.
    keep = lettered > 0
    starts, ends, which = starts[keep], ends[keep], which[keep]
    size = model.weights.shape[1]
    if not len(starts):
        return np.zeros((0, size), np.float32), which
    pair, triple = _gram_ids(raw)
    w = model.weights
    # A word's pairs and triples start one byte before it and end one byte after it.
    out = _range_sums(w, pair, starts - 1, ends) + _range_sums(w, triple, starts - 1, np.maximum(ends - 1, starts - 1))
    head, tail, lex = _word_ids(raw, starts, ends, model.lexicon)
    out += w[head] + w[tail]
    listed = lex >= 0
    out[listed] += w[lex[listed]]
    return out, which


def _range_sums(w, ids, starts, ends) -> np.ndarray:
    """Sum of the weights of ``ids[start:end]`` for each range."""
    flat = np.empty(2 * len(starts), dtype=np.int64)
    flat[::2], flat[1::2] = starts, ends
    rows = np.concatenate([w[ids], np.zeros((2, w.shape[1]), w.dtype)])
    sums = np.add.reduceat(rows, flat, axis=0)[::2]
    sums[ends <= starts] = 0
    return sums


def _messages(scores: np.ndarray, new_text: np.ndarray, transitions: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """(forward and backward messages, both with the word's own score; that score's exponential, scaled; that of the moves).

    ``new_text`` marks the first word of each text, where the chain starts
    afresh.  The chain is cut into rows of ``step`` words: each row's transfer
    matrix first, then the vectors at the cuts, then all rows at once.
    """
    n, size = scores.shape
    rows = -(-n // step)
    e = np.ones((rows * step, size))
    e[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    fresh = np.ones(rows * step, dtype=bool)
    fresh[:n] = new_text
    e, fresh = e.reshape(rows, step, size), fresh.reshape(rows, step)
    t = np.exp(transitions - transitions.max())
    even = np.full(size, 1.0 / size)

    def forward(v, s):
        moved = v @ t
        at = fresh[:, s]
        if at.any():
            moved[at] = v[at].sum(axis=-1, keepdims=True) * even
        return moved

    m = np.broadcast_to(np.eye(size), (rows, size, size)).copy()
    for s in range(step):
        m = forward(m, s) * e[:, s, None, :]
        m /= m.sum(axis=(1, 2), keepdims=True)
    enter, leave = np.empty((rows, size)), np.empty((rows, size))
    v = even
    for r in range(rows):
        enter[r] = v
        v = v @ m[r]
        v /= v.sum()
    v = np.ones(size)
    for r in range(rows - 1, -1, -1):
        leave[r] = v
        v = m[r] @ v
        v /= v.sum()
    alpha, beta = np.empty((rows, step, size)), np.empty((rows, step, size))
    v = enter
    for s in range(step):
        v = forward(v, s) * e[:, s]
        v /= v.sum(axis=1, keepdims=True)
        alpha[:, s] = v
    v = leave
    for s in range(step - 1, -1, -1):
        back = beta[:, s] = e[:, s] * v
        v = back @ t.T
        at = fresh[:, s]
        if at.any():
            v[at] = (back[at] @ even)[:, None]
        v /= v.sum(axis=1, keepdims=True)
    return alpha.reshape(-1, size)[:n], beta.reshape(-1, size)[:n], e.reshape(-1, size)[:n], t


def posteriors(scores: np.ndarray, new_text: np.ndarray, transitions: np.ndarray, step: int = 64) -> np.ndarray:
    """Posterior of each label for each word, by forward-backward."""
    if not len(scores):
        return np.zeros(scores.shape)
    alpha, beta, e, _ = _messages(scores, new_text, transitions, step)
    p = alpha * beta / np.maximum(e, 1e-300)
    return p / p.sum(axis=1, keepdims=True)


def pair_marginals(scores: np.ndarray, new_text: np.ndarray, transitions: np.ndarray, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors, sum of the posteriors of each move): what the likelihood's gradient needs.

    A move from word i - 1 to word i has the forward message of the one, the
    weight of the move, and the backward message of the other with its score.
    """
    alpha, beta, e, t = _messages(scores, new_text, transitions, step)
    p = alpha * beta / np.maximum(e, 1e-300)
    later = np.flatnonzero(~new_text)
    later = later[later > 0]
    joint = alpha[later - 1, :, None] * t * beta[later, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return p / p.sum(axis=1, keepdims=True), joint.sum(axis=0)


def labelled(texts: list[str | None], model: Model):
    """Yield (first text number, text number of each word, word posteriors) blocks of whole texts."""
    scores: list[np.ndarray] = []
    which: list[np.ndarray] = []
    held = 0

    def flush():
        w, s = np.concatenate(which), np.concatenate(scores)
        new = np.ones(len(w), dtype=bool)
        new[1:] = w[1:] != w[:-1]
        return w, posteriors(s, new, model.transitions)

    last = -1
    for group in W.slices(texts):
        if held > 100_000 and group[0][0] != last:
            yield flush()
            scores, which, held = [], [], 0
        s, w = _emissions(group, model)
        scores.append(s)
        which.append(w)
        held += len(w)
        last = group[-1][0]
    if which:
        yield flush()


def train(texts: list[str], labels: list[str], rounds: int = 30, length: int = 64, seed: int = 7) -> Model | None:
    """Fit a model on labelled texts; null where nothing can be learned."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    size = len(names)
    of = {x: i for i, x in enumerate(names)}
    lists, label_of, counts = [], [], {}
    for text, label in zip(texts, labels):
        raw, starts, ends, _ = W.split([(0, text)])
        keep = np.array([W.IN_LETTER[raw[a:b]].any() for a, b in zip(starts, ends)], dtype=bool)
        starts, ends = starts[keep], ends[keep]
        if len(starts):
            lists.append((raw, starts, ends))
            label_of.append(of[label])
            for key in W.hashes(raw, starts, ends).tolist():
                counts[key] = counts.get(key, 0) + 1
    if not lists:
        return None
    lexicon = np.array(sorted(sorted(counts, key=lambda k: (-counts[k], k))[: 2000 * size]), dtype=np.uint64)
    # Feature numbers of each word of each text.
    feats: list[np.ndarray] = []
    gold: list[np.ndarray] = []
    new: list[np.ndarray] = []
    texts_of: list[list[np.ndarray]] = []
    for raw, starts, ends in lists:
        pair, triple = _gram_ids(raw)
        head, tail, lex = _word_ids(raw, starts, ends, lexicon)
        texts_of.append([
            np.concatenate([pair[a - 1 : b], triple[a - 1 : b - 1], [h, t], [x] if x >= 0 else []]).astype(np.int64)
            for a, b, h, t, x in zip(starts.tolist(), ends.tolist(), head, tail, lex)
        ])
    # Splice: runs of some words of one text after runs of another.
    runs = [(d, a) for d in range(len(texts_of)) for a in range(0, len(texts_of[d]), length // 2)]
    for k, i in enumerate(rng.permutation(len(runs))):
        d, a = runs[i]
        take = texts_of[d][a : a + length // 2]
        feats += take
        gold.append(np.full(len(take), label_of[d]))
        start = np.zeros(len(take), dtype=bool)
        start[0] = k % 3 == 0
        new.append(start)
    total = len(feats)
    lengths = np.fromiter(map(len, feats), dtype=np.int64, count=total)
    used, flat = np.unique(np.concatenate(feats), return_inverse=True)
    offsets = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(total), lengths)
    y, fresh = np.concatenate(gold), np.concatenate(new)
    fresh[0] = True
    hot = np.zeros((total, size))
    hot[np.arange(total), y] = 1
    w = np.zeros((len(used), size))
    t = np.zeros((size, size))
    sw, st = np.full_like(w, 1e-8), np.full_like(t, 1e-8)
    inside = ~fresh
    inside[0] = False
    later = np.flatnonzero(inside)
    seen = np.zeros((size, size))
    np.add.at(seen, (y[later - 1], y[later]), 1)
    for _ in range(rounds):
        scores = np.add.reduceat(w[flat], offsets, axis=0)
        p, moves = pair_marginals(scores, fresh, t)
        gap = hot - p
        grad = np.stack([np.bincount(flat, weights=gap[owner, k], minlength=len(used)) for k in range(size)], axis=1) / total - 1e-7 * w
        sw += grad * grad
        w += 0.4 * grad / np.sqrt(sw)
        gt = (seen - moves) / total
        st += gt * gt
        t += 0.15 * gt / np.sqrt(st)
    weights = np.zeros((1 << BITS, size), dtype=np.float32)
    weights[used] = w
    return Model(names, weights, t, lexicon)


def training_rows(docs: DataFrame, id_col: str, text_col: str, label_col: str, train_docs: int, train_chars: int) -> list[tuple[str, str]]:
    """At most ``train_docs`` labelled rows, as many of each language, by hash of the id.

    Of each, a window of ``train_chars`` characters somewhere in the text is
    used.  Predictions always read whole texts.
    """
    usable = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy(F.col(label_col)).count().collect()}
    if not counts:
        return []
    each = max(1, train_docs // len(counts))
    share = F.element_at(F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 4 * each / n))))), F.col(label_col))
    at = F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(1 << 20)) / F.lit(1 << 20)
    room = F.greatest(F.length(text_col) - train_chars, F.lit(0))
    begin = (F.pmod(F.xxhash64(F.col(id_col), F.lit(2)), room + 1) + 1).cast("int")
    picked = usable.where(at < share).select(F.col(label_col).alias("label"), F.col(text_col).substr(begin, F.lit(train_chars)).alias("text"), at.alias("at"))
    rows = picked.orderBy("at").limit(8 * each * len(counts)).collect()
    left = dict.fromkeys(counts, each)
    out = []
    for r in rows:
        if left[r["label"]] > 0:
            left[r["label"]] -= 1
            out.append((r["text"], r["label"]))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_docs: int = 1200, train_chars: int = 600) -> Model | None:
    """A model trained on a bounded sample of the labelled rows of ``docs``."""
    rows = training_rows(docs, id_col, text_col, label_col, train_docs, train_chars)
    return train([t for t, _ in rows], [y for _, y in rows])


def _judge(texts: list[str | None], model: Model | None):
    """(language, score, words, switches) of each text."""
    n, size = len(texts), len(model.labels) if model else 1
    mass, words, switches = np.zeros((n, size)), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for which, p in labelled(texts, model) if model else ():
        if not len(which):
            continue
        first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        at = which[first]
        mass[at] = np.add.reduceat(p, first, axis=0)
        words[at] = np.diff(np.append(first, len(which)))
        best = p.argmax(axis=1)
        turn = np.append(False, (best[1:] != best[:-1]) & (which[1:] == which[:-1]))
        switches[at] = np.add.reduceat(turn.astype(np.int64), first)
    share = mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-300)
    best = share.argmax(axis=1)
    out = []
    for i, text in enumerate(texts):
        ok = model and words[i] and W.has_letter(text)
        out.append((model.labels[best[i]], min(1.0, float(share[i, best[i]])), int(words[i]), int(switches[i])) if ok else (UNDETERMINED, 0.0, 0, 0))
    return out


def _predict(batches, model):
    for batch in batches:
        lang, score, n, turns = zip(*_judge(batch.column(1).to_pylist(), model)) if batch.num_rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(turns, pa.int64())],
            ["doc_id", "lang_pred", "score", "n_words", "n_switches"],
        )


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, n_words, n_switches.

    ``score`` is the language's share of the word posteriors.  Texts that are
    null, empty or without a letter are ``und`` with score 0, and so is every
    text when there is no model (no labelled rows).  Equal shares go to the
    language first in alphabet.  Repeated rows and null ids each give their
    row; an empty table gives an empty result; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(lambda it: _predict(it, sent.value), "doc_id bigint, lang_pred string, score double, n_words bigint, n_switches bigint")


def label_words(text: str, model: Model) -> list[tuple[str, str]]:
    """(word, most probable language) for each lettered word of a text."""
    found = [w for part in W.parts(text) for w in _lettered(part)]
    best = np.concatenate([p.argmax(axis=1) for _, p in labelled([text], model)]) if found else []
    return [(w, model.labels[k]) for w, k in zip(found, best)]


def _lettered(part: str) -> list[str]:
    raw, starts, ends, _ = W.split([(0, part)])
    return [raw[a:b].tobytes().decode() for a, b in zip(starts, ends) if W.IN_LETTER[raw[a:b]].any()]


def _sift(batches, position: int, model, least: float):
    for batch in batches:
        judged = _judge(batch.column(position).to_pylist(), model)
        yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score, *_ in judged], pa.bool_()))


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose language is determined with a share of ``least`` or more; all columns stay.

    Null, empty and letterless texts go, and so does every row where there is
    no model.  Whole texts are judged, however long.  Of equal shares the first
    language by name counts, which changes nothing here.  Repeated rows are
    judged alike; ids and other columns are not read, so they may be null and
    have any names.  An empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    position = docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: _sift(it, position, sent.value, least), docs.schema)

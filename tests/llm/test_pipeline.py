"""The pipeline's stages, each against what it should do with the rows it gets."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import zlib
from tokenizers import Tokenizer

from lanternfish.llm import near_dedup, secret_scan, words

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EN = "the a of and to in is was for on with as by at from harbour boat water morning light window garden letter winter number people house river stone bread market".split()
FR = "le la les des et un une dans est pour sur avec par au de maison bateau lumière fenêtre jardin lettre hiver nombre gens rivière pierre pain marché matin eau".split()
KEY = "q7Zx0PfK2mVw9TbR4nLc8HsY1dGj"


def prose(vocabulary, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(vocabulary) + str(r.randint(0, 9)) * (r.random() < 0.1) for _ in range(n))


def rows():
    out = [(i, prose(EN if i % 2 else FR, 80, i), "en" if i % 2 else "fr", "s") for i in range(40)]
    out += [(100 + i, out[i % 3][1], "en" if i % 2 else "fr", "t") for i in range(9)]  # exact copies
    base = prose(EN, 150, 77)
    for i in range(8):  # near copies
        w = base.split()
        w[3 + 15 * i] = "changed"
        out.append((200 + i, " ".join(w), "en", "u"))
    out += [(300, f"{prose(EN, 60, 5)} password = hunter2hunter2 {prose(EN, 30, 6)}", "en", "v"), (301, f"{prose(FR, 70, 9)} {KEY} {prose(FR, 9, 8)}", "fr", "v")]
    out += [(400, None, "en", "w"), (401, "", None, "w"), (402, "!? ½", None, "w"), (403, prose(EN, 30_000, 11), "en", "w"), (None, prose(FR, 90, 12), None, None), (1, out[1][1], "en", "s")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in out]


def near_truth(texts):
    keys = list(words.word_hashes(texts))
    df = np.zeros(1 << near_dedup.DF_BITS)
    for k in keys:
        df[np.unique(near_dedup._df_slot(k))] += 1
    idf = (np.log((1.0 + len(texts)) / (1.0 + df)) + 1).astype(np.float32)
    sets = [near_dedup.weighted_shingles(k, idf) for k in keys]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.similarity(sets[i], sets[j]) >= 0.8:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def pieces(texts_by_id):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in texts_by_id:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            b = first if a == 0 else a + 1024
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return want


def digest(df):
    return Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())


def test_stages(spark, tmp_path):
    given = rows()
    spark.createDataFrame(given, KIND).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packed" or out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()

    kept = lambda name: Counter((r["doc_id"], r["text"], r["source"]) for r in seen[name])
    assert kept("language") == Counter((i, t, s) for i, t, _, s, _ in given if t and words.has_letter(t))
    exact = seen["exact"]
    texts = {r["text"] for r in seen["language"]}
    assert Counter(r["text"] for r in exact) == Counter(dict.fromkeys(texts, 1))
    for r in exact:
        assert r["doc_id"] == max((x["doc_id"] for x in seen["language"] if x["text"] == r["text"] and x["doc_id"] is not None), default=None)
    groups = defaultdict(list)
    for g, r in zip(near_truth([r["text"] for r in exact]), exact):
        groups[g].append(r)
    first = lambda m: min(m, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert kept("near") == Counter((r["doc_id"], r["text"], r["source"]) for r in map(first, groups.values()))
    assert sum(len(m) > 1 for m in groups.values()) >= 1

    ranks, make = secret_scan.load_encoding(P.path("byte_bpe_50k.tiktoken"))
    e = make(ranks)
    masked = lambda t: secret_scan.masked(t, secret_scan.find_spans(t, lambda s: len(e.encode_ordinary(s)), 2.0))
    assert kept("secrets") == Counter((r["doc_id"], masked(r["text"]), r["source"]) for r in seen["near"])
    assert not any(KEY in r["text"] or "hunter2" in r["text"] for r in seen["secrets"])
    assert digest(docs) == pieces([(r["doc_id"], r["text"]) for r in seen["secrets"]])
    assert digest(corpus_pipeline.run(spark, str(tmp_path))) == digest(docs)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

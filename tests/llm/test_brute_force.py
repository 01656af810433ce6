"""Operators that SQL can't express, against plain versions and bounds."""

import random

import numpy as np
import public_tokenizers
import regex
import zstandard
from pyspark.sql import functions as F

from clausemill.llm import entry, language, packing, passages, quality, sharding, toxicity


def novel(r, n):
    """Words that no other text has."""
    return [f"w{r.getrandbits(40):x}" for _ in range(n)]


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_of_passages_are_found(spark):
    """Passages of over 50 words with up to three edits that leave 5-gram similarity of 0.8 or more: nine in ten are found, and none between other texts."""
    r, rows, pairs = random.Random(7), [], {}
    for length, edits in [(52, 0), (55, 0), (60, 0), (120, 0), (60, 1), (80, 1), (120, 1), (120, 2), (200, 2), (200, 3)] * 14:
        passage = novel(r, length)
        copy = passage.copy()
        for _ in range(edits):
            at = r.randrange(len(copy))
            copy[at : at + 1] = r.choice([novel(r, 1), [], novel(r, 2)])
        if jaccard(passage, copy) < 0.8:
            continue
        ids = (len(rows), len(rows) + 1)
        for text in (passage, copy):
            rows.append((len(rows), " ".join([*novel(r, r.randint(30, 90)), *text, *novel(r, r.randint(30, 90))])))
        pairs[ids] = (length, edits)
    found = passages.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {}
    for x in found:
        groups.setdefault(x["component_id"], set()).add(x["doc_id"])
    assert all(tuple(sorted(g)) in pairs for g in groups.values())
    caught = {tuple(sorted(g)) for g in groups.values()}
    for exact in (True, False):
        these = [p for p, (_, edits) in pairs.items() if (edits == 0) == exact]
        share = np.mean([p in caught for p in these])
        assert share >= (0.98 if exact else 0.9), (exact, share, len(these))


def test_toxicity_equals_a_plain_version(spark):
    r = random.Random(3)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in ("ban", "dor", "fel", "gim", "hus")]
    docs = [(i, " ".join(r.choice(words) if r.random() > 0.05 * (i % 4 == 0) else "quorbly" for _ in range(r.randint(5, 120)))) for i in range(120)] + [(500, None), (501, ""), (502, "x" * 100_000), (503, " quorbly" * 3000)]
    frame = spark.createDataFrame(docs, "id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] + [(3, None), (None, 1)], "id long, label int")
    model = toxicity.fit(frame, labels)
    assert len(model.weights)
    dictionaries = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (model.ordinary, model.toxic + model.ordinary)]
    for d in dictionaries:
        d.precompute_compress(level=12)

    def plain(text):
        split, saved = (text or "").lower().split(), []
        for at in range(0, len(split), 5):
            window = f" {' '.join(split[at : at + 5])} ".encode()
            a, b = (len(zstandard.ZstdCompressor(level=12, dict_data=d, write_content_size=False, write_checksum=False).compress(window)) for d in dictionaries)
            saved.append(a - b)
        n, one, three = len(saved), sum(max(0, s - 1) for s in saved), sum(max(0, s - 3) for s in saved)
        x = [1, min(8, max([0, *saved])), np.log1p(one), one / (n + 10), np.log1p(three), three / (n + 10), sum(s > 2 for s in saved) / (n + 10), np.log1p(n)]
        return 1 / (1 + np.exp(-np.clip(np.dot(x, model.weights), -30, 30)))

    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model, id_col="id").collect()}
    assert got.keys() == {i for i, _ in docs}
    assert all(abs(got[i] - plain(text)) < 1e-9 for i, text in docs)


def test_toxicity_fits_on_repeated_ids(spark):
    r = random.Random(5)
    ordinary = [f"{a}{b}" for a in ("ka", "lo", "mi") for b in ("ban", "dor", "fel")]
    docs = [(i, " ".join(r.choice(ordinary) for _ in range(40)) + (" zwiffle quorbly zwiffle" if i % 2 else "")) for i in range(40)]
    repeated = spark.createDataFrame(docs * 100, "id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "id long, label int")
    model = toxicity.fit(repeated, labels, sample=20)
    score = {r["doc_id"]: r["score"] for r in toxicity.score(repeated.distinct(), model, id_col="id").collect()}
    assert len(model.weights) and np.mean([score[i] > score[i - 1] for i in range(1, 40, 2)]) > 0.9


def plain_language(model, text):
    """(label, share) of one text, word by word."""
    words = [w.encode() for w in regex.findall(r"[A-Za-z\x80-\U0010ffff]+", text or "")]
    if not model.langs or not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    best = back = None
    path = []
    for word in words:
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in word)
        content, ends = np.frombuffer(low, np.uint8), np.array([len(low)])
        score = np.zeros(len(model.langs))
        for bucket, _ in language._grams(content, np.array([0]), ends):
            for b in bucket:
                score += model.table[b]
        score[~model.allowed[max([0, *(language.SCRIPT[b] for b in low)])]] = -1e4
        if best is None:
            best = score
        else:
            top = best.argmax()
            switch = best < best[top] - model.penalty
            path.append(np.where(switch, top, np.arange(len(best))))
            best = np.where(switch, best[top] - model.penalty, best) + score
    label = [int(best.argmax())]
    for back in reversed(path):
        label.append(int(back[label[-1]]))
    votes = np.bincount(label, minlength=len(model.langs))
    return model.langs[int(votes.argmax())], votes.max() / len(label)


def test_language_equals_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = entry._language_model(docs)
    few = docs.where("n_chars < 1500").orderBy("doc_id").limit(60).select("doc_id", "text").collect() + [(-1, None), (-2, "12 -"), (-3, "")]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(few, "doc_id long, text string"), model).collect()}
    assert len(got) == len(few)
    same = 0
    for i, text in few:
        label, share = plain_language(model, text)
        same += got[i]["lang_pred"] == label and abs(got[i]["score"] - share) < 0.02
    assert same >= len(few) - 1  # sums of 32-bit numbers may break a tie otherwise


def test_more_languages_than_a_byte_counts(spark):
    names = [f"l{n:03}" for n in range(300)]
    r = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stems = {n: ["".join(r.choice(letters) for _ in range(6)) for _ in range(4)] for n in names}
    rows = [(" ".join(r.choice(stems[n]) for _ in range(12)), n) for n in names for _ in range(2)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame([(n, " ".join(r.choice(stems[name]) for _ in range(12))) for n, name in enumerate(names)], "doc_id long, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert np.mean([found[n] == name for n, name in enumerate(names)]) > 0.95
    assert np.mean([found[n] == names[n] for n in range(257, 300)]) > 0.95


def test_language_takes_different_texts(spark):
    hot = spark.range(3000).select(F.lit("eins zwei drei vier").alias("text"), F.lit("de").alias("lang"))
    rows = spark.createDataFrame([(f"wort{n} satz{n}", "de") for n in range(50)] + [(f"word{n} text{n}", "en") for n in range(50)], "text string, lang string")
    picked = language.sampled(hot.unionByName(rows), 20)
    assert {r["lang"]: r["count"] for r in picked.groupBy("lang").count().collect()} == {"de": 20, "en": 20}
    assert picked.select("text").distinct().count() == 40


def test_sequences_are_near_the_bound(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = packing.pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    tokens, sequences = packed.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    bound = -(-tokens // 2048)
    assert bound <= sequences <= 1.02 * bound + 1


def plain_differencing(sizes, parts):
    """Sums of the parts after repeatedly combining the two partitions of largest spread."""
    rows = [sorted([s] + [0] * (parts - 1), reverse=True) for s in sizes]
    while len(rows) > 1:
        rows.sort(key=lambda x: x[0] - x[-1])
        a, b = rows.pop(), rows.pop()
        rows.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
    return rows[0]


def test_differencing_equals_a_plain_version():
    r = random.Random(2)
    for parts in (2, 3, 8):
        sizes = r.sample(range(1, 10_000), 60)  # without ties any order of combining is the same
        part = sharding._halves(np.array(sizes), parts)
        sums = sorted(np.bincount(part, weights=sizes, minlength=parts).astype(int).tolist(), reverse=True)
        assert max(sums) - min(sums) <= max(sizes)
        want = plain_differencing(sizes, parts)
        assert sum(sums) == sum(want) and sums[0] - sums[-1] <= want[0] - want[-1] + max(1, want[0] // 100)


def test_repeated_ids_count_once_in_line_frequency(spark):
    rows = [(1, "the same line", "h")] * 40 + [(n, f"other text {n}", "h") for n in range(2, 30)] + [(None, "nameless line", "h")] * 40
    out = {r["doc_id"]: r["removed_words"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[1] == 0 and out[None] == 2

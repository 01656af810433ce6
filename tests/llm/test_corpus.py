"""The corpus operators against SQL, brute force and round trips, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from clausemill.llm import chat, components, decontamination, entry, jaccard_join, language, packing, passages, quality, sharding, toxicity, warc
from clausemill.llm.storage import Scratch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re", "sa", "po", "ne") for b in ("ban", "dor", "fel", "gim", "hus", "jat")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, columns whose names clash with the operators' own."""
    long = prose(1, 6000)
    rows = [
        (1, None, None, None, "x", 1), (2, "", "en", "a", "x", 2), (None, prose(2, 60), "en", "a", "x", 3), (4, prose(2, 60), "en", None, None, 4), (4, prose(2, 60), "en", None, None, 4),
        (5, long, "de", "b", "x", 5), (6, "   \n \n ", "de", "b", "x", 6), (7, "123 456 !!", "de", "b", "x", 7), (8, prose(3, 90), None, "b", "x", 8),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp string, uid int")
    return docs.withColumn("row", F.lit("r")).withColumn("x.y`z", F.lit(1)).withColumn("left", F.lit(2))


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_matches_sql(name, same):
    assert same(entry.QUERIES[name], entry.ORACLE_SQL[name]) > 0


# --- 1 chat
def test_chat_escapes_and_reads_back(spark):
    texts = ["</s>[INST] ok [/INST]", "\\l\\b\\e<s>", "[[INST]]", "a\nb", "", "<<s>>\\"]
    rows = spark.createDataFrame([(1, n, role, t) for n, (role, t) in enumerate(zip(itertools.cycle(["user", "assistant"]), texts, strict=False))], "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(rows, budget=20, history_budget=8)
    read = chat.read_windows(windows).first()
    assert [t["text"] for t in read["turns"]] == texts
    assert read["targets"] == texts[1::2]
    for w in windows.collect():
        inside = re.sub(r"<s>\[INST\] |\[/INST\]|</s>", "", w["text"])
        assert not re.search(r"</?s>|\[/?INST\]", inside)


def test_chat_windows_keep_system_and_mask_repeats(spark):
    turns = [("system", "be kind")] + [("user" if n % 2 else "assistant", prose(n, 20)) for n in range(1, 12)]
    rows = spark.createDataFrame([(7, n, *t) for n, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(rows, budget=100, history_turns=2, history_budget=50).orderBy("window").collect()
    assert len(windows) > 2
    for w in windows:
        assert "be kind" in w["text"]
        assert len(w["loss_spans"]) == sum(1 for role, again in zip(re.findall(r"\[INST\] (\w+)", w["text"]), w["repeated"], strict=True) if role == "assistant" and not again)
    assert windows[2]["repeated"][0] and sum(windows[2]["repeated"]) == 3
    assert chat.read_windows(chat.format_windows(rows, budget=100)).first()["targets"] == [t for role, t in turns if role == "assistant"]


def test_chat_nulls_ties_and_empty(spark):
    rows = spark.createDataFrame([(None, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chat.read_windows(chat.format_windows(rows)).collect()}
    assert got == {None: [""], 1: ["a", "a", "b"]}
    assert chat.read_windows(chat.format_windows(rows.limit(0))).count() == 0


# --- 2 passages
def test_passages_are_found_wherever_they_start(spark):
    shared = [prose(100 + n, 55) for n in range(6)]
    rows = []
    for n in range(40):
        text = prose(n, 80 + n)
        if n % 2:
            cut = 7 * n % 60
            words = text.split()
            text = " ".join(words[:cut]) + " " + shared[n % 6] + " " + " ".join(words[cut:])
        rows.append((n, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.find(docs).collect()
    assert {r["doc_id"] for r in found} == {n for n in range(40) if n % 2}
    kept = [r for r in found if not r["removed"]]
    assert {tuple(sorted({r["kept_doc_id"] for r in found if r["component_id"] == k["component_id"]})) for k in kept} == {(k["doc_id"],) for k in kept}
    left = {r["doc_id"]: r["text"] for r in passages.remove(docs).collect()}
    for text in shared[1::2]:
        core = " ".join(text.split()[2:-2])
        assert sum(core in t for t in left.values()) == 1
    assert all(left[n] == dict(rows)[n] for n in range(0, 40, 2))


def test_passages_tolerate_edits_but_not_other_texts(spark):
    text = prose(5, 120).split()
    near = text.copy()
    near[60] = "changed"
    docs = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(near)), (3, prose(6, 120))], "doc_id long, text string")
    rows = passages.find(docs).collect()
    assert {r["doc_id"] for r in rows} == {1, 2}
    assert max(r["words"] for r in rows) == 120


def test_passages_with_a_word_changed_or_put_in(spark):
    def found(seed, n, put_in):
        rng = np.random.default_rng(seed)
        passage, *around = (rng.integers(1, 2**63, k, dtype=np.uint64) for k in (n, 70, 70, 50, 50))
        copy = np.insert(passage, n // 2, np.uint64(7)) if put_in else np.where(np.arange(n) == n // 2, np.uint64(7), passage)
        spans = passages.common(np.concatenate([around[0], passage, around[1]]), np.concatenate([around[2], copy, around[3]]), 24, 6, 3, 80, 40)
        return any(start <= 70 + n // 10 and start + words >= 70 + n - n // 10 for start, words, _, _ in spans)

    assert np.mean([found(seed, 60, False) for seed in range(100)]) > 0.95
    assert np.mean([found(seed, 60, True) for seed in range(100)]) > 0.85


def test_passages_are_found_although_the_leader_has_too_little_of_them(spark):
    from pyspark.sql.types import LongType, StringType, StructType

    passage = prose(1218, 56).split()
    texts = [" ".join([prose(701, 60), *passage[9:47], prose(702, 60)])]  # 38 words
    texts += [" ".join([prose(703 + 2 * n, 60), *passage, prose(704 + 2 * n, 60)]) for n in range(4)]
    schema = StructType().add("doc_id", LongType()).add("text", StringType())
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], schema)
    hashes = {r["doc_id"]: r["h"] % 2**64 for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    short = next(f" s{n}" for n in range(10**6) if spark_least(spark, texts[0] + f" s{n}") < min(hashes[i] for i in range(1, 5)))
    docs = spark.createDataFrame([(0, texts[0] + short), *((n, t) for n, t in enumerate(texts) if n)], schema)
    found = {(r["doc_id"], r["removed"]) for r in passages.find(docs).collect()}
    assert {i for i, removed in found if removed} | {i for i, removed in found if not removed} == {1, 2, 3, 4}
    assert len([i for i, removed in found if removed]) == 3


def spark_least(spark, text):
    return spark.sql("SELECT xxhash64(:t) AS h", args={"t": text}).first()["h"] % 2**64


def test_passages_edge_cases(odd, none):
    rows = passages.find(odd).collect()
    assert {r["doc_id"] for r in rows} == {4, None}
    assert all(r["kept_doc_id"] == 4 for r in rows)
    assert sorted(str(r["doc_id"]) for r in passages.remove(odd).select("doc_id").collect()) == ["1", "2", "4", "5", "6", "7", "8"]
    nameless = odd.where("doc_id = 4 or doc_id is null").withColumn("doc_id", F.lit(None).cast("long"))
    assert passages.remove(nameless).count() == 1 and passages.find(nameless).where("removed").count() == 2
    assert passages.remove(odd).columns == odd.columns
    assert passages.find(none).count() == 0 and passages.remove(none).count() == 0


# --- 3 toxicity
def labelled(spark, n, seed):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = prose(seed * 1000 + i, r.randint(40, 200)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(3, 8)):
                words.insert(r.randrange(len(words)), r.choice(["zwiffle", "quorbly", "xanthip"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(labels, "id long, label int")


def test_toxicity_on_held_out_texts(spark):
    docs, labels = labelled(spark, 240, 1)
    model = toxicity.fit(docs, labels)
    fresh, truth = labelled(spark, 120, 2)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(fresh, model, id_col="id").collect()}
    want = {r["id"]: r["label"] for r in truth.collect()}
    right = sum((got[i] >= 0.7) == bool(want[i]) for i in got)
    assert right >= 114
    assert all(0 <= s <= 1 for s in got.values())


def test_toxicity_edge_cases(spark, odd, none):
    docs, labels = labelled(spark, 40, 3)
    model = toxicity.fit(docs, labels)
    assert toxicity.score(odd, model).where("score between 0 and 1").count() == odd.count()
    assert toxicity.score(none, model).count() == 0
    alone = toxicity.fit(docs, labels.where("label = 0"))
    assert {r["score"] for r in toxicity.score(docs, alone, id_col="id").collect()} == {0.0}


# --- 4 decontamination
def test_several_passes_give_the_same(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    columns = ["doc_id", "n_words", "n_hit", "items", "spans"]
    once, many = (sorted(map(str, decontamination.contamination(docs, items, most_bytes=b).select(columns).collect())) for b in (1 << 26, 900))
    assert once == many and any("Row(word=" in r for r in once)


def test_removal_in_several_passes_gives_what_one_pass_gives(spark):
    words = prose(900, 200).split()
    items = spark.createDataFrame([(f"i{n}", " ".join(words[n : n + 30])) for n in range(0, 160, 10)], "item_id string, text string")
    rows = [(1, " ".join([prose(901, 200), *words[:80], prose(902, 200)])), (2, " ".join([prose(903, 100), *words[20:170]])), (3, prose(904, 50)), (4, None)]
    rows += [(5, " ".join([*words[20:50], prose(905, 30), *words[100:130], prose(906, 10)]))]  # 60 of 100 words
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once, many = (sorted(map(str, decontamination.remove_hits(docs, items, most_bytes=b).collect())) for b in (1 << 26, 900))
    assert once == many and len(once) == 3


def test_winnowing_meets_every_shared_span():
    r = np.random.default_rng(5)
    span = r.integers(0, 1 << 63, 10).astype(np.uint64)
    for n in range(200):
        a, b = (np.concatenate([r.integers(0, 1 << 63, r.integers(0, 30)).astype(np.uint64), span, r.integers(0, 1 << 63, r.integers(0, 30)).astype(np.uint64)]) for _ in range(2))
        (_, x), (_, y) = (decontamination.winnow(v, np.zeros(len(v), np.int64), 5, 10) for v in (a, b))
        assert set(x.tolist()) & set(y.tolist())


def test_hits_are_cut_out(spark):
    item = prose(50, 14)
    docs = spark.createDataFrame([(1, f"Été début {item}! fin ça", 9), (2, item, 9), (3, None, 9), (4, "clean text", 9)], "doc_id long, text string, words int")
    items = spark.createDataFrame([(1, item.upper()), (2, None), (None, "clean text"), (3, "")], "item_id long, text string")
    out = {r["doc_id"]: r["text"] for r in decontamination.remove_hits(docs, items, most_share=0.9).collect()}
    assert out == {1: "Été début ! fin ça", 3: None, 4: "clean text"}
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontamination.contamination(docs, items).collect()}
    assert got == {1: (14, ["1"]), 2: (14, ["1"]), 3: (0, []), 4: (0, [])}


def test_short_items_and_edges(odd, none, spark):
    items = spark.createDataFrame([(1, "123 456")], "item_id long, text string")
    assert [r["doc_id"] for r in decontamination.contamination(odd, items).where("n_hit > 0").collect()] == [7]
    assert decontamination.contamination(none, items).count() == 0
    assert decontamination.contamination(odd, items.limit(0)).where("n_hit > 0").count() == 0


# --- 5 quality
def test_frequent_lines_deplete(spark):
    banner = prose(9, 60)
    rows = [(n, f"{banner}\n{prose(n, 12)}" if n % 2 else f"{prose(n, 70)}\nFooter  LINE", "h") for n in range(60)]
    out = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[n]["kept"] == (n % 2 == 0) for n in range(60))
    assert out[0]["removed_words"] == 2 and out[1]["removed_words"] == 60


def test_quality_edge_cases(odd, none):
    out = sorted((str(r["doc_id"]), r["n_words"], r["kept"]) for r in quality.judge(odd).collect())
    assert len(out) == odd.count() and ("1", 0, False) in out and ("5", 6000, True) in out
    assert quality.judge(none).count() == 0


# --- 6 packing
def test_packing_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack(odd, tokenizer=TOKENIZER, limit=512).collect()
    want = []
    for r in odd.collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(str(r["doc_id"]), n // 512, n, len(ids[n : n + 512]), zlib.crc32(ids[n : n + 512].tobytes())) for n in range(0, len(ids), 512)]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    for _, some in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in some:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
    assert packing.pack(none, tokenizer=TOKENIZER).count() == 0


def test_encoder_equals_the_tokenizer():
    encoder = packing.WordEncoder(TOKENIZER)
    r = random.Random(2)
    alphabet = [*"aAbB.,!'sSt0Éé́JjΣİß \n\t\x1c\xa0 <|>", "<|endoftext|>", "'s", ". ", ", "]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, encoder(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_local_search_drains_bins():
    lengths = np.array([6, 5, 5, 4, 4, 3, 3])  # 30 in three bins of 10
    bins = packing.local_search([[0, 3], [1, 4], [2, 5], [6]], lengths, 10)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(7)) and all(lengths[b].sum() <= 10 for b in bins)


def test_local_search_goes_on_until_nothing_helps():
    lengths = np.random.default_rng(1).integers(500, 801, 2048)
    bins = packing.local_search(packing.best_fit_decreasing(lengths, 2048), lengths, 2048)
    assert len(bins) <= 680 and sorted(i for b in bins for i in b) == list(range(2048)) and all(lengths[b].sum() <= 2048 for b in bins)


# --- 7 language
def test_language_spans(spark):
    rows = [(n, prose(n, 30), "x") for n in range(30)] + [(n, " ".join(w[::-1] for w in prose(n, 30).split()), "y") for n in range(30, 60)]
    model = language.fit(spark.createDataFrame(rows, "id long, text string, lang string"))
    mixed = prose(70, 40) + " " + " ".join(w[::-1] for w in prose(71, 60).split())
    docs = spark.createDataFrame([(1, mixed), (2, prose(72, 20)), (3, None), (4, "12 — 34"), (5, "")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert [(s["lang"], s["words"]) for s in out[1]["spans"]] == [("x", 40), ("y", 60)]
    assert [out[n]["lang_pred"] for n in (1, 2, 3, 4, 5)] == ["y", "x", "und", "und", "und"]
    assert out[1]["score"] == 0.6 and out[3]["score"] == 0.0


def test_viterbi_equals_a_plain_one():
    r = np.random.default_rng(1)
    counts = np.array([0, 7, 1, 30, 7])
    scores = r.normal(size=(counts.sum(), 3)).astype(np.float32)
    got = language.viterbi(scores, counts, 1.5)
    for at, n in zip(np.cumsum(counts) - counts, counts, strict=True):
        best, back = None, []
        for row in scores[at : at + n]:
            if best is None:
                best = row.copy()
                continue
            top = best.argmax()
            switch = best < best[top] - np.float32(1.5)
            back.append(np.where(switch, top, np.arange(3)))
            best = np.where(switch, best[top] - np.float32(1.5), best) + row
        if n:
            path = [best.argmax()]
            for b in reversed(back):
                path.append(b[path[-1]])
            assert got[at : at + n].tolist() == path[::-1]


def test_scripts_narrow_candidates(spark):
    rows = [(prose(n, 30), "la") for n in range(10)] + [("привет мир как дела сегодня хорошо", "cy")] * 10
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame([(1, "кабан"), (2, "kaban")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()} == {1: "cy", 2: "la"}


def test_language_edge_cases(odd, none):
    model = language.fit(odd)
    assert language.identify(odd, model).count() == odd.count()
    assert language.accepted(odd, model).columns == odd.columns
    assert language.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, language.fit(none)).collect()} == {"und"}


def test_language_accuracy(spark, sf_dir):
    found = entry.QUERIES["op7_language_id"](spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count()


# --- 8 WARC
def test_warc_round_trip_and_random_access(spark):
    rows = [(n, f"http://x/{n}", None if n == 3 else ("é" * 700 if n % 5 == 0 else f"page {n} " * (n * 40))) for n in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    bundles = warc.write_bundles(pages, Scratch(spark), frame_bytes=4000, bundle_bytes=20_000)
    out = {r["page_id"]: r for r in warc.read_records(bundles).collect()}
    assert len(out) == 40
    for n, _, html in rows:
        body = (html or "").encode()
        assert out[n]["payload_bytes"] == len(body) and out[n]["payload_digest"] == hashlib.sha1(body).hexdigest()
        revisits = n % 5 == 0 and n != 35
        assert (out[n]["record_type"], out[n]["refers_to"]) == (("revisit", 35) if revisits else ("response", None))
        assert revisits or bytes(out[n]["payload"]) == body
    got = warc.fetch(bundles, spark.createDataFrame([("7",), ("11",)], "record_id string")).collect()
    assert {warc.parse(bytes(r["data"]))[0]["WARC-Target-URI"] for r in got} == {"http://x/7", "http://x/11"}


def test_warc_bundle_is_plain_zstandard(spark, tmp_path):
    import io

    import zstandard

    pages = spark.createDataFrame([(n, "u", "x" * 50) for n in range(30)], "page_id long, url string, html string")
    bundles = warc.write_bundles(pages, Scratch(spark), frame_bytes=500)
    files = warc.export(bundles, f"file://{tmp_path}").collect()
    for f in files:  # by the footer alone
        reader = warc.Reader(open(f["file"], "rb").read())
        assert sum(reader.frame(n).count(b"WARC/1.1\r\n") for n in reversed(range(len(reader.frames)))) > 0
    text = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(f["file"], "rb").read()), read_across_frames=True).read() for f in files)
    assert text.count(b"WARC/1.1\r\n") == 30


def test_warc_edge_cases(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "a\nb", "y" * 1200), (1, "c", "y" * 1200), (None, "z", "y" * 1200)], "page_id long, url string, html string")
    out = warc.read_records(warc.write_bundles(pages, Scratch(spark))).collect()
    assert sorted((str(r["page_id"]), r["record_type"]) for r in out) == [("1", "response"), ("1", "response"), ("None", "response"), ("None", "response")]
    assert warc.write_bundles(pages.limit(0), Scratch(spark)).count() == 0
    named = spark.createDataFrame([("b\r\n>", "u", "y" * 1200), ("a", "u", "y" * 1200)], "page_id string, url string, html string")
    out = warc.read_records(warc.write_bundles(named, Scratch(spark)), id_type="string").collect()
    assert {r["page_id"]: r["refers_to"] for r in out} == {"b\r\n>": None, "a": "b\r\n>"}


# --- 9 n-gram join
def brute_components(rows, k, percent):
    def shingled(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [shingled(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
            parent[root(j)] = root(i)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    return {rows[i][0]: min(rows[m][0] for m in members) for members in groups.values() for i in members}


@pytest.mark.parametrize(("k", "percent", "heavy"), [(4, 85, 16), (5, 80, 3), (1, 60, 2)])
def test_join_equals_brute_force(spark, k, percent, heavy):
    r = random.Random(k * percent)
    rows, bases = [], [prose(n, r.choice([3, 12, 60, 200])) for n in range(12)]
    common = prose(99, 40)
    for n in range(220):
        words = r.choice(bases).split()
        for _ in range(int(len(words) * r.choice([0, 0, 0.01, 0.02, 0.04, 0.06, 0.2]) + r.random())):
            words[r.randrange(len(words))] = r.choice(WORDS) + "x"
        text = " ".join(words) + (" " + common if n % 3 == 0 else "")
        rows.append((n, text if n % 40 else r.choice([None, "", "  "])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.near_components(docs, k=k, percent=percent, heavy=heavy).collect()}
    assert got == brute_components(rows, k, percent)


def test_one_of_each_stays(odd, none):
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "5", "6", "7", "8"]
    assert jaccard_join.one_of_each(none).count() == 0
    assert jaccard_join.near_components(none, k=4, percent=85).count() == 0
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard_join.near_components(odd, k=4, percent=85).collect())
    assert got == [("1", "1"), ("2", "2"), ("4", "4"), ("4", "4"), ("5", "5"), ("6", "6"), ("7", "7"), ("8", "8"), ("None", "4")]


def test_components_of_a_long_path(spark):
    n = 300
    order = random.Random(1).sample(range(n), n)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5, 5)], "u long, v long").repartition(40)
    got = {r["node"]: r["component"] for r in components.connected(edges, Scratch(spark), "path").collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}


# --- 10 sharding
def test_shards_are_even_and_groups_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sharding.shard(docs.unionByName(docs)).collect()
    size, slots, where = {}, {}, {}
    for r in rows:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert where.setdefault(r["text_crc32"], r["shard"]) == r["shard"]
    assert len(rows) == 2 * docs.count()
    assert max(size.values()) - min(size.values()) <= 0.02 * sum(size.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_differencing_on_a_classic_case():
    sizes = np.array([8, 7, 6, 5, 4])
    part = sharding._halves(sizes, 2)
    assert abs(sizes[part == 0].sum() - sizes[part == 1].sum()) == 2


def test_shard_edge_cases(odd, none):
    rows = sharding.shard(odd).collect()
    assert len(rows) == odd.count() and min(r["size"] for r in rows) == 1
    assert {r["text_crc32"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert sharding.shard(none).count() == 0


# --- pipeline
def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r["doc_id"]: r["text"] for r in docs.collect()}
    scratch = Scratch(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before
        if name == "near_copies":
            want = brute_components(sorted((i, truth[i]) for i in before), 5, 80)
            assert set(after) == {i for i in want if want[i] == i}
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    hits = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert hits.where("n_hit > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(after)

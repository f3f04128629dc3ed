"""The operators against brute force, exact round trips and held-out labels."""

import dataclasses
import functools
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
import trie_model
from pagewright.llm import components, fingerprints, line_dedup, mixing, ngram_join, packing, ppm, quality, queries, sql, toxicity, url_filter, warc
from pagewright.storage import shared_path

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


def documents(spark, sf=SMALL):
    return spark.read.parquet(f"{sf}/documents.parquet")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# 1 fingerprints


def phrases(text):
    found, phrase = set(), ""
    for char in text:
        phrase += char
        if phrase not in found:
            found.add(phrase)
            phrase = ""
    return found


def test_fingerprints_of_neighbours(spark):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in documents(spark).collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.neighbour_fingerprints(documents(spark)).collect()}
    assert len(got) == len(rows)
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        row = got[doc_id]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == fingerprints.fingerprint(text)
        assert row["edited_fingerprint"] == fingerprints.fingerprint(edited)
        assert row["near_next"] == fingerprints.compare(row["fingerprint"], fingerprints.fingerprint(following))
        if min(len(phrases(text)), len(phrases(edited))) > 100:
            exact = len(phrases(text) & phrases(edited)) / len(phrases(text) | phrases(edited))
            assert abs(row["near_edited"] - exact) < 0.2


# 2 n-gram join


def classes_by_brute_force(texts, words, percent):
    sets = {}
    for i, text in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(rng):
    """A large group at the threshold, chains, exact copies, short texts and a passage in many texts."""
    words = [f"w{i}" for i in range(400)]
    base, passage = rng.choices(words, k=150), rng.choices(words, k=60)
    texts = ["", "a", "a b", "A\nb", "a b c", "x y z w", "X Y z w", " ".join(base)]
    for _ in range(120):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(150)] = f"new{rng.random()}"
        texts.append(" ".join(copy))
    chain = list(base)
    for i in range(12):
        chain[i * 10] = f"step{i}"
        texts.append("chain " + " ".join(chain))
    for n in (2, 5, 10, 20, 60, 200):
        texts += [" ".join(rng.choices(words, k=n) + passage) for _ in range(12)]
    return texts


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, words, percent):
    texts = near_copies(random.Random(words))
    rows = ngram_join.similar_documents(frame(spark, texts), words, percent).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got == classes_by_brute_force(dict(enumerate(texts)), words, percent)


def test_registered_join_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    rows = queries.ngram_jaccard_join(spark, SMALL).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == classes_by_brute_force(texts, 4, 85)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}


# 3 toxicity


def test_toxicity_on_held_out_labels(spark):
    scores = queries.score_toxicity(spark, MIDDLE).toPandas()
    known = scores.merge(spark.read.parquet(f"{MIDDLE}/labels.parquet").toPandas(), on="doc_id")
    assert (known["held_out"] == known["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = known[known["held_out"]]
    toxic, clean = held["score"][held["toxic"] == 1], held["score"][held["toxic"] == 0]
    auc = np.mean([(x > clean).mean() + (x == clean).mean() / 2 for x in toxic])
    assert auc > 0.8 and ((held["score"] >= 0.5) == (held["predicted"] == 1)).all()
    assert held["predicted"][held["toxic"] == 0].mean() < 0.1 and scores["score"].between(0, 1).all()


def test_toxic_documents_of_every_language_are_found(spark):
    folder = "/root/testdata/sf0.1"
    scores = queries.score_toxicity(spark, folder).toPandas()
    known = scores.merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    known = known.merge(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = known[known["held_out"]]
    bound = held["score"][held["toxic"] == 0].quantile(0.95)
    for lang, rows in held[held["toxic"] == 1].groupby("lang"):
        assert (rows["score"] > bound).mean() >= 0.85 and (rows["predicted"] == 1).mean() >= 0.8, lang
    assert (held["predicted"][held["toxic"] == 0]).mean() < 0.01


def test_lexicons_leave_their_own_fold_out(spark):
    rng = random.Random(3)
    rows = [(f"{'mordaxen' if i % 4 == 0 else 'plain'} {rng.choice('abcdefgh') * 5}{' onlyhere' if i % 20 == 0 else ''}", float(i % 4 == 0), 0 if i % 20 == 0 else i % 5) for i in range(400)]
    learned = toxicity.lexicons(spark.createDataFrame(rows, "text string, label double, fold int"))
    assert len(learned) == toxicity.FOLDS + 1
    assert all("mordaxen" in x and "morda~" in x and "plain" not in x for x in learned)
    assert ["onlyhere" in x for x in learned] == [False, True, True, True, True, True]


@pytest.mark.parametrize("text", ["!" * 10**6, "1+" * 500_000, "you idiot " * 100_000, "a.b" * 300_000, "x" * 10**6])
def test_features_of_long_texts_are_linear(text):
    made, begun = toxicity.TextFeatures({"idiot": 1.0, "xxxx~": 1.0}), time.perf_counter()
    assert len(made.of(text)) == len(toxicity.FEATURES) and time.perf_counter() - begun < 1


def test_disguised_and_aimed_words():
    made = dict(zip(toxicity.FEATURES, toxicity.TextFeatures().of("You are an id1ot, a l.o.s.e.r and SCUM!!! Clownish."), strict=True))
    assert made["disguised_listed"] == 2 and made["distinct_listed"] == 1 and made["near_reader"] > 0 and made["exclamations"] > 0
    assert set(toxicity.TextFeatures().of("")[1:5]) == {0.0}


# 4 prediction by partial matching


def test_scores_equal_brute_force(spark):
    docs = documents(spark)
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts, trie = Counter(), defaultdict(Counter)
    start = bytes([ppm.START]) * ppm.ORDER
    form = {i: start + b" ".join(w) + bytes([ppm.FINISH]) for i, w in texts.items()}
    for i, words in texts.items():
        if not held[i]:
            counts.update([*words, None])
            for p in range(ppm.ORDER, len(form[i])):
                for k in range(ppm.ORDER + 1):
                    trie[form[i][p - k : p]][form[i][p]] += 1
    total, room = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)

    @functools.cache
    def coded(gram):
        excluded, result = set(), 0.0
        for k in range(ppm.ORDER, -1, -1):
            left = {b: n for b, n in trie.get(gram[ppm.ORDER - k : -1], {}).items() if b not in excluded}
            if not left:
                continue
            if gram[-1] in left:
                return result + math.log10((left[gram[-1]] - 0.5) / sum(left.values()))
            result += math.log10(0.5 * len(left) / sum(left.values()))
            excluded |= set(left)
        return result - math.log10(256 - len(excluded))

    rows = {r["doc_id"]: r for r in ppm.score(docs).collect()}
    assert len(rows) == len(texts)
    for i, words in texts.items():
        every = [*words, None]
        assert (rows[i]["held_out"], rows[i]["n_tokens"], rows[i]["train_tokens"]) == (held[i], len(every), total)
        assert rows[i]["n_known"] == sum(counts[w] > 0 for w in every)
        assert rows[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / room) for w in every))
    for i in texts:
        assert rows[i]["score"] == pytest.approx(sum(coded(form[i][p - ppm.ORDER : p + 1]) for p in range(ppm.ORDER, len(form[i]))))


def test_pruned_trie_stays_a_distribution(spark):
    grams, _ = ppm.grams_of([b"abracadabra", b"abc", b""])
    keys, counts = np.unique(grams, return_counts=True)
    counted = spark.createDataFrame(pd.DataFrame({"key": keys.view(np.int64), "n": counts}))
    for most in (1000, 6):
        model = trie_model.train(counted, most).prepare()
        for context in (b"abrac", b"zzzzz", b"\xfe\xfe\xfeab"):
            whole = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], dtype=np.uint64)
            assert (10 ** model.log10(whole)).sum() == pytest.approx(1)


@pytest.mark.parametrize("most", [0, 2000])
def test_scores_do_not_depend_on_what_goes_to_the_tasks(spark, monkeypatch, most):
    docs = documents(spark)
    want = {r["doc_id"]: r["score"] for r in ppm.score(docs).collect()}
    monkeypatch.setattr(ppm, "MOST_GRAMS", most)
    assert {r["doc_id"]: r["score"] for r in ppm.score(docs).collect()} == pytest.approx(want)


def test_log_probabilities_equal_the_whole_trie(spark):
    seen, _ = ppm.grams_of([b"abracadabra", b"abc", b"", b"a cad a bra"])
    new, _ = ppm.grams_of([b"abrakadabra", b"zzzzzzzzz", b"cab"])
    for training in (seen, seen[:0]):
        n, m = Counter(training.tolist()), Counter([*training.tolist(), *new.tolist()])
        rows = spark.createDataFrame([(k, n[k], m[k]) for k in m], "key long, n long, m long")
        keys, counts = np.unique(training, return_counts=True)
        counted = spark.createDataFrame(list(zip(keys.tolist(), counts.tolist(), strict=True)), "key long, n long")
        model = trie_model.train(counted).prepare()
        got = {r["key"]: r["log"] for r in ppm.log_probabilities(rows).collect()}
        every = np.array(sorted(m), dtype=np.uint64)
        assert got == pytest.approx(dict(zip(every.tolist(), model.log10(every).tolist(), strict=True)))


def test_lookup_finds_all_keys_and_no_others():
    rng = np.random.default_rng(1)
    keys = np.unique(np.append(rng.integers(0, 2**63, 300_000), 0)).astype(np.uint64)
    made = ppm.Lookup(keys, np.arange(len(keys), dtype=float))
    values, found = made.get(keys)
    assert found.all() and (values == np.arange(len(keys))).all()
    assert not made.get(rng.integers(2**63, 2**64 - 1, 1000, dtype=np.uint64))[1].any()


# 5 line dedup


def test_index_is_reversible(spark):
    first = frame(spark, ["a\nb\n\nb", "A \nc", "a", None])
    second = spark.createDataFrame([(10, "\ta\nc"), (11, "c\nd")], "doc_id long, text string")
    index = line_dedup.LineIndex(min_docs=3).insert(first)
    both = index.insert(second)
    state = lambda x: sorted((bytes(r["key"]), r["n_docs"]) for r in x.refs.collect())
    assert state(both.delete(second)) == state(index) and state(both.delete(first)) == state(line_dedup.LineIndex().insert(second))
    kept = lambda i: {r["doc"]["doc_id"]: r["kept"] for r in line_dedup.kept_text(i.clean(first)).collect()}
    assert kept(both) == {0: "b\n\nb", 1: "", 2: "", 3: ""}
    assert kept(both.delete(second)) == {0: "b\n\nb", 1: "c", 2: "", 3: ""}
    assert not {f.name for f in dataclasses.fields(line_dedup.LineIndex)} & {"filter_bytes"}


def held_filters(index):
    return {r["shard"]: line_dedup.CuckooFilter.from_bytes(bytes(r["data"])) for r in index.filters.collect()}


def test_filters_change_in_place_with_the_counts(spark):
    rng = random.Random(6)
    texts = ["\n".join(rng.choice("abcdefgh") + str(rng.randint(0, 60)) for _ in range(30)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    of = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    index = line_dedup.LineIndex(min_docs=3, shards=4).insert(of(rows[:20]))
    for step in (lambda x: x.insert(of(rows[20:50])), lambda x: x.delete(of(rows[5:30])), lambda x: x.insert(of(rows[50:])), lambda x: x.delete(of(rows[:5]))):
        index = step(index)
        made, hashed = held_filters(index), index._sharded(index.refs).collect()
        elements = Counter(r["shard"] for r in hashed if r["n_docs"] >= 3)
        # No common key is missing, and what was taken out is gone: each filter has one mark for each common key.
        assert {s: np.count_nonzero(f.table) + len(f.rest) for s, f in made.items() if f.table.any() or f.rest} == elements
        for r in hashed:
            if r["n_docs"] >= 3:
                assert made[r["shard"]].contains(np.array([r["hash"]]))[0]
    left = [r for r in rows[30:]]
    plain = line_dedup.LineIndex(min_docs=3, shards=4).insert(of(left))
    assert sorted((bytes(r["key"]), r["n_docs"]) for r in plain.refs.collect()) == sorted((bytes(r["key"]), r["n_docs"]) for r in index.refs.collect())
    kept = lambda x: sorted((r["doc"]["doc_id"], r["kept"]) for r in line_dedup.kept_text(x.clean(of(rows))).collect())
    assert kept(index) == kept(plain)


def test_a_full_filter_is_made_anew(spark):
    of = lambda n, k: spark.createDataFrame([(i, "\n".join(f"line {j}" for j in range(k))) for i in n], "doc_id long, text string")
    index = line_dedup.LineIndex(min_docs=2, shards=2).insert(of(range(2), 3)).insert(of(range(10, 12), 4000))
    made = held_filters(index)
    assert sum(np.count_nonzero(f.table) for f in made.values()) == 4000 and not any(f.rest for f in made.values())
    assert max(f.load for f in made.values()) <= line_dedup.FULL


def test_cleaning_is_linear_in_the_lines(spark):
    lines = [f"line {i}" for i in range(60_000)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i:])) for i in range(3)], "doc_id long, text string")
    begun = time.perf_counter()
    rows = {r["doc"]["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.dedup_lines(docs, 3).collect()}
    assert rows == {0: (60_000, 59_998, "line 0\nline 1"), 1: (59_999, 59_998, "line 1"), 2: (59_998, 59_998, "")}
    assert time.perf_counter() - begun < 30


def test_cuckoo_filter_forgets_nothing():
    rng = np.random.default_rng(3)
    values = rng.integers(-(2**63), 2**63, 5000)
    made = line_dedup.CuckooFilter.from_bytes(line_dedup.CuckooFilter.of(values).to_bytes())
    assert made.contains(values).all()
    assert made.contains(rng.integers(-(2**63), 2**63, 20000)).mean() < 0.01
    for value in values[:2500].tolist():
        made.delete(value)
    assert made.contains(values[2500:]).all() and made.contains(values[:2500]).mean() < 0.05
    crowded = line_dedup.CuckooFilter(1)
    for value in values[:40].tolist():
        crowded.insert(value)
    assert crowded.contains(values[:40]).all() and crowded.rest


# 6 mixing


def test_poisson_copies(spark):
    rows = [(i, "x" * 10, "small" if i % 10 == 0 else "large") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("small", 0.75), ("large", 0.25)], "source string, weight double")
    drawn = mixing.replicated(docs, targets=targets, total=6.0).groupBy("doc.doc_id", "doc.source").agg(F.count("*").alias("n"), F.first("rate").alias("rate")).toPandas()
    small = drawn[drawn["source"] == "small"]
    assert small["rate"].iloc[0] == pytest.approx(45.0)
    assert small["n"].sum() / 2000 == pytest.approx(45, rel=0.02) and small["n"].var() == pytest.approx(45, rel=0.15)
    large = drawn[drawn["source"] == "large"]
    counts = Counter(large["n"]) + Counter({0: 18_000 - len(large)})
    for k in range(5):
        assert counts[k] / 18_000 == pytest.approx(math.exp(-5 / 3) * (5 / 3) ** k / math.factorial(k), abs=0.015)
    again = mixing.mix(docs, targets=targets, total=6.0).limit(50).collect()
    assert again == mixing.mix(docs.repartition(7), targets=targets, total=6.0).limit(50).collect()
    assert len({r["source"] for r in again}) == 2


# 7 URL filter


@pytest.mark.parametrize(
    "url, verdict",
    [
        ("http://casino-win.example.net/", "block"), ("http://a.net/poker/slots", "block"), ("http://a.net/pokers/casinos1", "allow"),
        ("http://a.net/x?q=poker", "allow"), ("http://a.net/x?q=poker&r=%73lots", "block"), ("http://a.net/poker/poker", "allow"),
        ("http://a.net/jackpot", "allow"), ("http://a.net/jackpot/prizes", "block"), ("http://a.net/loan/bonus", "allow"), ("http://a.net/loan/bonus/prizes", "block"),
        ("http://\u00e9casino.net/", "allow"), ("http://%63asino.net/", "block"),
        ("http://a.net/#casino", "allow"), ("HTTP://X.Com/fr/casino", "allow"), ("http://notexample.org/es/", "allow"),
        ("http://example.org/en/12", "block"), ("http://s.example.org/en/2", "allow"), ("http://org", "allow"),
    ],
)
def test_url_verdicts(url, verdict):
    assert url_filter.UrlJudge().judge(url)[3] == verdict


def test_vocabulary_has_no_labels_of_the_given_hosts(spark):
    urls = [r["url"] for r in spark.read.parquet(f"{MIDDLE}/pages.parquet").select("url").collect()]
    labels = {label for url in urls for label in url_filter.UrlJudge().judge(url)[0].split(".") if "-" in label}
    halves = {half for label in labels for half in label.split("-")}
    # No list of such words is without this one.
    assert labels and (labels | halves) & {*url_filter.STRICT, *url_filter.SOFT} <= {"casino"}


def test_sql_has_the_boundary_and_percent_rules_of_the_operator(spark):
    urls = ["http://\u00e9casino.net/", "http://%63asino.net/x", "http://a.net/x?q=poker&r=%73lots#casino", "http://a.net/1casino/casino%20", "HTTP://POKER.net/Jackpot", None, "casino", "http://x.org/casino"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    folder = shared_path(spark)
    pages.write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.execute(sql.URL_VOCABULARY).df().sort_values("page_id")
    got = queries.url_vocabulary(spark, folder).toPandas().sort_values("page_id")
    for name in ("verdict", "strict_terms", "soft_terms", "soft_weight"):
        assert got[name].tolist() == want[name].tolist(), name


# 8 WARC


def test_archives_have_a_dictionary_and_single_records(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    path = shared_path(spark)
    warc.write_archives(pages, path)
    want = {r["page_id"]: (r["url"], (r["html"] or "").encode()) for r in pages.collect()}
    read = warc.read_archives(spark, path).collect()
    assert {r["page_id"]: (r["url"], bytes(r["payload"])) for r in read if r["record_type"] == "response"}.items() <= want.items()
    assert len(read) == len(want)
    archives = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()]
    for data in (a for a in archives if a):
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    words = [int.from_bytes(a[4:8], "little") + 8 for a in archives if a]
    plain = sum(len(x) for a in archives for x in warc.archive_frames(a))
    assert sum(map(len, archives)) - sum(words) < plain / 3


def test_dictionary_knows_markup_at_the_end_of_long_pages(spark):
    rng = random.Random(5)
    tags = [f"<li class='{rng.getrandbits(64):x}'>" for _ in range(40)]
    rows = [(i, f"http://h.e/{i}", f"{rng.getrandbits(80_000):x}{''.join(tags)}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    words = warc.train_dictionary(pages)
    assert sum(tag.encode() in words for tag in tags) > 20


# 9 packing


def test_pieces_rebuild_all_ids(spark):
    from tokenizers import Tokenizer

    docs = documents(spark)
    exact = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = {r["doc_id"]: exact.encode(r["text"] or "", add_special_tokens=False).ids + [packing.END] for r in docs.collect()}
    for length in (64, 2048):
        pieces = packing.pack(docs.repartition(20), length=length, open_windows=4, with_ids=True).toPandas()
        assert {i: [t for ids in g.sort_values("start")["ids"] for t in ids] for i, g in pieces.groupby("doc_id")} == want
        for row in pieces.itertuples():
            assert row.ids_crc32 == zlib.crc32(np.array(row.ids, dtype="<u4").tobytes()) and row.doc_tokens == len(want[row.doc_id])
        for _, group in pieces.groupby("sequence_id"):
            group = group.sort_values("offset")
            assert (group["offset"].to_numpy() == np.cumsum(group["length"]).to_numpy() - group["length"].to_numpy()).all()
            assert group["length"].sum() <= length
        total = pieces["length"].sum()
        assert pieces["sequence_id"].nunique() <= total / length * 1.1 + 2


def test_words_have_the_tokenizer_s_ids():
    path, rng = public_tokenizers.path(packing.TOKENIZER), random.Random(4)
    signs = ["a", "B", "é", "É", "ß", "İ", "Σ", "ς", "'s", "'t", " ", "\n", "\x1c", "\x85", "\u0301", "1", "½", ".", ",", "!?", "<|endoftext|>", "🙂", "漢", "ÿ", "×", "µ"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(3000)]
    from tokenizers import Tokenizer

    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for exact in (False, True):
        assert [x.tolist() for x in packing.WordTokenizer(path, exact).encode(pa.array(texts))] == want


# 10 quality rules


def test_base_statistics_equal_brute_force(spark):
    loops = ["a b c d e f g h " * 3, "x " * 30, "a b c d e f g\nh i", "l\nl\n \nl", " ".join(str(i % 9) for i in range(40))]
    for row in quality.statistics(frame(spark, loops)).collect():
        text = loops[row["doc_id"]]
        words = re.findall("[^\x20\x09-\x0d]+", text)
        places = defaultdict(list)
        for i in range(len(words) - 7):
            places[tuple(words[i : i + 8])].append(i)
        covered = {i + k for found in places.values() if len(found) > 1 for i in found for k in range(8)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
        assert (row["n_words"], row["word_chars"], row["n_repeat_words"], row["n_dup_lines"]) == (
            len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)),
        )


def test_statistics_of_all_documents_equal_brute_force(spark):
    rows = {r["doc_id"]: r["text"] or "" for r in documents(spark).collect()}
    judged = queries.weak_supervision(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in judged) == sorted(rows)
    for row in judged:
        text = rows[row["doc_id"]]
        words = re.findall("[^\x20\x09-\x0d]+", text)
        places = defaultdict(list)
        for i in range(len(words) - 7):
            places[tuple(words[i : i + 8])].append(i)
        covered = {i + k for found in places.values() if len(found) > 1 for i in found for k in range(8)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
        assert (row["n_words"], row["word_chars"], row["n_repeat_words"], row["n_dup_lines"], row["n_lines"]) == (
            len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)), len(lines),
        )
        assert row["n_symbols"] == sum(text.count(x) for x in "#*$%&|<>")
        assert row["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_accuracies_come_from_all_rows(spark):
    judged = queries.weak_supervision(spark, SMALL)
    assert judged.where("base_failed").count() > 0
    found = quality.posterior(quality.RULES, *quality.estimate(judged))
    for row in judged.select("posterior", found.alias("want")).collect():
        assert row["posterior"] == pytest.approx(row["want"])


def test_posteriors_equal_iterations_over_all_rows(spark):
    """Expectation-maximisation row by row, without patterns."""
    judged = queries.weak_supervision(spark, SMALL).toPandas()
    votes = judged[[f"vote_{r.name}" for r in quality.RULES]].fillna(-1).to_numpy()
    yes, no, n = votes == 1, votes == 0, len(quality.RULES)
    prior, good, bad = 0.8, np.full(n, 0.95), np.full(n, 0.4)

    def posterior():
        odds = np.log(prior / (1 - prior)) + (yes * np.log(good / (1 - bad)) + no * np.log((1 - good) / bad)).sum(axis=1)
        return 1 / (1 + np.exp(-odds))

    for _ in range(30):
        p = posterior()[:, None]
        prior = np.clip(p.mean(), 0.05, 0.95)
        good, bad = (
            np.clip(((q * hit).sum(axis=0) + old) / ((q * (yes | no)).sum(axis=0) + 1), *limits)
            for q, hit, old, limits in ((p, yes, good, (0.5, 0.9999)), (1 - p, no, bad, (0.02, 0.98)))
        )
        bad = np.maximum(bad, np.minimum(0.98, 1.2 * (1 - good)))
    want = posterior()
    assert judged["posterior"].to_numpy() == pytest.approx(want, abs=1e-6)
    assert (judged["kept"] == (~judged["base_failed"] & (want >= 0.5))).all()


def test_one_weak_bad_vote_is_outvoted_and_two_are_not(spark):
    rules = quality.RULES[:4]
    known = {r.name: quality.Accuracy(0.9, 0.5) for r in rules}
    rows = [(1, 1, 1, 1), (0, 1, 1, 1), (0, 0, 1, 1), (0, 0, None, None), (None, None, None, None), (0, None, None, None)]
    votes = spark.createDataFrame(rows, ", ".join(f"vote_{r.name} int" for r in rules))
    found = [r["p"] >= 0.5 for r in votes.select(quality.posterior(rules, 0.7, known).alias("p")).collect()]
    assert found == [True, True, False, False, True, False]


def test_single_bad_votes_do_not_decide_on_the_given_documents(spark):
    judged = queries.weak_supervision(spark, "/root/testdata/sf0.1").toPandas()
    bad = (judged[[f"vote_{r.name}" for r in quality.RULES]] == 0).sum(axis=1)
    single = judged[(bad == 1) & ~judged["base_failed"]]
    assert len(single) > 50 and single["kept"].mean() > 0.9
    assert not judged["kept"][bad >= 5].any()


def test_verdicts_follow_labels_nobody_gave(spark):
    judged = queries.weak_supervision(spark, MIDDLE).toPandas()
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").toPandas().rename(columns={"quality": "label"})
    known = judged[~judged["base_failed"]].merge(labels, on="doc_id")
    assert known["kept"][known["label"] == 1].mean() > 0.99 and known["kept"][known["label"] == 0].mean() < 0.2
    assert not judged["kept"][judged["base_failed"]].any()


def test_estimated_accuracies(spark):
    rng = random.Random(2)
    rules = quality.RULES[:4]
    rates = [(0.999, 0.9), (0.995, 0.6), (0.99, 0.3), (0.999, 0.5)]
    rows = []
    for _ in range(6000):
        good = rng.random() < 0.8
        rows.append([None if rng.random() < 0.2 else int(good == (rng.random() < (g if good else b))) for g, b in rates])
    votes = spark.createDataFrame(rows, ", ".join(f"vote_{r.name} int" for r in rules))
    prior, found = quality.estimate(votes, rules, 60)
    assert prior == pytest.approx(0.8, abs=0.05)
    for rule, (_, bad) in zip(rules, rates, strict=True):
        assert found[rule.name].bad == pytest.approx(bad, abs=0.12)

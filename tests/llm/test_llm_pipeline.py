"""The pipeline stage by stage, on planted cases."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
from test_llm_operators import classes_by_brute_force

import corpus_pipeline
from pagewright.llm import packing, sql, toxicity
from pagewright.storage import materialize

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(8)
    plain = " ".join(rng.choice(["river", "stone", "paper", "cloud", "green", "walks", "under"]) + str(rng.randint(0, 99)) for _ in range(120))
    insult = " ".join(["quiet", "words", "and", "you", "worthless", "pathetic", "idiot", "scum"] * 3)
    line = "This line stands in very many documents of the corpus."
    planted = [(90_000, plain), (90_001, plain + " end"), (90_002, insult)] + [(91_000 + i, f"{plain[i:]} {i}\n{line}") for i in range(0, 600, 50)]
    more = spark.createDataFrame([(i, t, "en", "planted", len(t)) for i, t in planted], docs.schema)
    now = materialize(docs.unionByName(more))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, materialize(stage(spark, now, "/root/testdata/sf0.01"))
        if name != "packing":
            assert now.columns == docs.columns
        kept[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert kept[name] <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "line_dedup":
            assert not now.where(now["text"].contains(line)).count() and now.count() == before.count()
    assert 90_002 not in kept["toxicity"] and 90_000 in kept["toxicity"]
    assert 90_000 in kept["ngram_join"] and 90_001 not in kept["ngram_join"]
    assert kept["packing"] == kept["mixing"] and len(kept["mixing"]) > 0.5 * len(kept["ngram_join"])


def test_run(spark):
    pieces = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(pieces.columns)
    full = pieces.groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    # Nearly all sequences are full where there is more than the windows that one task leaves open.
    assert (full <= 2048).all() and len(full) <= 1.1 * full.sum() / 2048 + 2


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def without_toxic(spark, docs):
    scores = toxicity.scored(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
    toxic = {r["doc_id"] for r in scores if r["score"] >= 0.5}
    return [r for r in docs.collect() if r["doc_id"] not in toxic]


def without_common_lines(docs):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))
    rows, holders = docs.collect(), defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            holders[key(line)].add(r["doc_id"])
    made = []
    for r in rows:
        text = "\n".join(x for x in (r["text"] or "").split("\n") if not key(x) or len(holders[key(x)]) < 10)
        made.append({**r.asDict(), "text": text, "n_chars": len(text)}.values())
    return made


def one_of_each(docs):
    rows = docs.collect()
    classes = classes_by_brute_force({r["doc_id"]: r["text"] for r in rows}, 5, 80)
    return [r for r in rows if classes[r["doc_id"]][1] == r["doc_id"]]


def copies(docs):
    rows = {r["doc_id"]: r for r in docs.collect()}
    connection = duckdb.connect()
    connection.register("given", docs.toPandas())
    connection.execute("CREATE VIEW documents AS SELECT * FROM given")
    drawn = connection.execute(f"SELECT doc_id FROM ({sql.POISSON_MIXING})").fetchall()
    return [rows[i] for (i,) in drawn]


def test_every_stage_equals_its_plain_version(spark):
    from tokenizers import Tokenizer

    now = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        want = {"toxicity": lambda d: without_toxic(spark, d), "line_dedup": without_common_lines, "ngram_join": one_of_each, "mixing": copies}[name](now)
        after = materialize(stage(spark, now, SMALL))
        assert plain(after.collect()) == plain(want) and want, name
        now = after
    assert corpus_pipeline.STAGES[4][0] == "packing"
    exact = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want, firsts, ids = Counter(), Counter(), {}
    for r in now.collect():
        ids[r["doc_id"]] = exact.encode(r["text"] or "", add_special_tokens=False).ids + [packing.END]
        want[r["doc_id"]] += len(ids[r["doc_id"]])
        firsts[r["doc_id"]] += 1
    pieces = corpus_pipeline.STAGES[4][1](spark, now, SMALL).collect()
    got, begun = Counter(), Counter()
    for r in pieces:
        got[r["doc_id"]] += r["length"]
        begun[r["doc_id"]] += r["start"] == 0
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, dtype="<u4").tobytes())
    assert got == want and begun == firsts

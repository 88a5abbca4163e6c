"""The pipeline's stages take effect and hand on the columns of documents."""
import corpus_pipeline as C
from reviewlens.llm import packing, toxicity
from reviewlens.llm.common import read_table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    raw = read_table(spark, SF, "documents")
    docs, kept = raw, {}
    for name, stage in C.STAGES:
        out = C.written(stage(spark, docs, SF), "test-stage")
        if name != C.STAGES[-1][0]:
            assert out.columns == raw.columns
        kept[name], docs = out.collect(), out
    ids = {name: {r["doc_id"] for r in rows} for name, rows in kept.items()}
    all_rows = {r["doc_id"]: r["text"] for r in raw.collect()}
    # toxicity: what the model predicts goes
    model = toxicity.train(raw, read_table(spark, SF, "labels"))
    gone = {r["doc_id"] for r in toxicity.score(raw, model).collect() if r["predicted"]}
    assert ids["toxicity"] == set(all_rows) - gone
    # exact: the largest id of each text
    best = {}
    for i in ids["toxicity"]:
        best[all_rows[i]] = max(i, best.get(all_rows[i], -1))
    assert ids["exact_dedup"] == set(best.values())
    # near: the smallest id of each component
    from test_simhash import slow
    rows = [(i, all_rows[i]) for i in ids["exact_dedup"]]
    assert ids["simhash_near_dedup"] == {c for _, _, c in slow(rows)}
    # pii: same documents, no address left as it was
    assert ids["pii_surrogates"] == ids["simhash_near_dedup"]
    text = {r["doc_id"]: r["text"] for r in kept["pii_surrogates"]}
    assert not [i for i, t in text.items() if "@" in t and t == all_rows[i]]
    # packing: every piece of every document once
    coder = packing.encoding(C.vocabulary_path())
    want = sorted((i, k, s, n) for i, t in text.items()
                  for k, (s, n) in enumerate(packing.cut(len(coder.encode(t, allowed_special="all")) + 1)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in kept["best_fit_packing"]) == want


def test_run_gives_the_last_stages_columns(spark):
    assert C.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

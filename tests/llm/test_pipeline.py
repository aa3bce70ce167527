"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import re

import corpus_pipeline as pipeline


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, data)
        out.write.parquet(f"file://{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{name}")
        kept[name] = (before, docs)
        if name != "token_output":
            assert docs.columns == columns
    ids = {n: tuple(sorted(r["doc_id"] for r in d.select("doc_id").collect()) for d in pair) for n, pair in kept.items()}
    assert set(ids["toxicity"][1]) < set(ids["toxicity"][0])

    sets = {}
    for r in kept["near_duplicates"][0].collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and sets[j] and len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert list(ids["near_duplicates"][1]) == sorted(i for i in sets if find(i) == i)

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bench = set()
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        w = words(r["text"])
        bench |= {tuple(w[j : j + min(10, len(w))]) for j in range(max(0, len(w) - 10) + 1)} if w else set()
    sizes = {len(b) for b in bench}
    clean = [r["doc_id"] for r in kept["decontamination"][0].collect() if not any(tuple(w[j : j + k]) in bench for w in [words(r["text"])] for k in sizes for j in range(len(w) - k + 1))]
    assert list(ids["decontamination"][1]) == sorted(clean)

    assert set(ids["source_mix"][1]) <= set(ids["source_mix"][0])
    assert all(ids["source_mix"][1].count(i) <= 2 for i in set(ids["source_mix"][1]))
    assert ids["token_output"][1] == ids["source_mix"][1]

"""The pipeline's stages, each on what the one before it kept."""

from __future__ import annotations

import re

from foliolake.llm import decontamination, mixing, quality, registry

from ..conftest import DATA


def one_of_each(docs, words, percent):
    """By brute force: ids of the documents that no smaller one is linked with, directly or by others; linked are those that share so much of their runs of words."""
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        own = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^ \t-\r]+", r.text or "")]
        sets[r.doc_id] = {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return sorted(d for d, g in group.items() if d == g)


def test_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for k, (name, step) in enumerate(p.STAGES):
        out = step(spark, docs, DATA)
        assert k == len(p.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        kept[k] = (before, docs)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = kept[0]
    assert ids(after) == ids(quality.judge(before).where("kept"))
    before, after = kept[1]
    assert ids(after) == one_of_each(before, 5, 80) != ids(before)
    before, after = kept[2]
    found = set(ids(decontamination.leaks(before, spark.read.parquet(f"{DATA}/benchmark.parquet"))))
    assert found and ids(after) == [i for i in ids(before) if i not in found]
    before, after = kept[3]
    want = [r.doc_id for r in mixing.taken_words(before).collect() if r.size for _ in range(int(r.taken / r.size + 0.5))]
    assert ids(after) == sorted(want)
    before, after = kept[4]
    assert ids(after) == ids(before) and after.where("shard is null").count() == 0


def test_the_latent_space_of_the_stage_is_fitted_on_all_documents(spark, monkeypatch):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen, own = [], decontamination.gram
    monkeypatch.setattr(decontamination, "gram", lambda texts, *rest: (seen.append(sorted(bytes(x.text or b"") for x in texts.collect())), own(texts, *rest))[1])
    assert p.drop_leaks(spark, docs, DATA).count() < docs.count()
    assert seen == [sorted((x.text or "").encode() for x in docs.collect())]


def test_all_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_near_copies_between_the_thresholds_go(spark):
    import corpus_pipeline as p

    one = [f"w{i}" for i in range(141)]
    other = [f"x{i}" if i in (35, 70, 105) else w for i, w in enumerate(one)]
    third = [f"y{i}" if i % 20 == 10 else w for i, w in enumerate(one)]
    runs = lambda own, k: {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
    share = lambda a, b, k: 100 * len(runs(a, k) & runs(b, k)) / len(runs(a, k) | runs(b, k))
    assert share(one, other, 5) >= 80 and share(one, other, 4) < 85 and max(share(one, third, 5), share(other, third, 5)) < 80
    docs = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(other)), (3, " ".join(third))], "doc_id long, text string")
    assert sorted(r.doc_id for r in p.keep_one_of_near_copies(spark, docs, DATA).collect()) == [1, 3]


def test_awkward_documents_are_judged_one_by_one(spark):
    import corpus_pipeline as p

    from .cases import empty

    one, other, third = (" ".join(f"{c}{i}" for i in range(120)) for c in "abc")
    rows = [(3, one), (5, one + " more"), (5, other), (7, third), (7, third), (None, one), (None, " ".join(f"d{i}" for i in range(90))), (9, None), (10, ""), (11, "e " * 40_000)]
    docs = spark.createDataFrame([(d, t, "en", "s", None, 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp int")
    out = p.keep_one_of_near_copies(spark, docs, DATA)
    assert out.columns == docs.columns
    kept = sorted(((r.doc_id, (r.text or "")[:3]) for r in out.collect()), key=str)
    assert [k for k in kept if k[0] not in (None, 3, 5)] == [(10, ""), (11, "e e"), (7, "c0 "), (9, "")]
    assert sum(t == "a0 " for _, t in kept) == 1 and (5, "b0 ") in kept and (None, "d0 ") in kept
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(1, item), (1, one), (None, item), (None, other)], "doc_id long, text string")
    assert sorted(r.text[:3] for r in p.drop_leaks(spark, docs, DATA).collect()) == ["a0 ", "b0 "]
    none = empty(spark)
    for _, step in p.STAGES:
        assert step(spark, none, DATA).count() == 0

import corpus_pipeline as P


def test_stages(spark, sf, docs):
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "lines", "near_copies", "repeats", "packing"] and P.ORACLE_SQL is None
    now, ids = docs, {r.doc_id for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
        kept = {r.doc_id for r in now.collect()}
        assert kept <= ids and (len(kept) == len(ids)) == (name in ("lines", "repeats"))
        ids = kept
    packed = P.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == ids


def test_empty_documents(spark, sf, docs):
    now = docs.limit(0)
    for _, stage in P.STAGES:
        now = stage(spark, now, sf) if now.columns == docs.columns else now
    assert now.count() == 0


def test_odd_rows_through_every_stage(spark, sf, odd_docs, monkeypatch):
    """Nulls, empty and very long texts, repeated rows and clashing names: columns stay, and nothing appears from nowhere."""
    import maskrisk.llm.quality_mil as Q

    monkeypatch.setattr(Q, "ACCEPT", 0.0)  # so that every row reaches the later stages
    now = odd_docs
    rows = sorted(str(r.doc_id) for r in odd_docs.collect())
    for name, stage in P.STAGES[:-1]:
        now = P.written(stage(spark, now, sf), name)
        assert now.columns == odd_docs.columns
        kept = sorted(str(r.doc_id) for r in now.collect())
        assert set(kept) <= set(rows) and (name == "near_copies" or kept == rows)
        rows = kept
    texts = {r.doc_id: r.text for r in now.collect()}
    assert 1 in texts and None in texts and rows.count("2") <= 1 and texts[6]
    packed = P.STAGES[-1][1](spark, now, sf).collect()
    assert sorted({str(r.doc_id) for r in packed}) == sorted(set(rows))

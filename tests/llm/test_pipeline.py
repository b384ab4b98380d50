"""The pipeline's stages against plain versions of each."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from flowsift.llm import common, pii, quality

from .test_pairs import groups, shingles
from .test_tokens import check_packing


def row(r):
    return tuple(r)


def kept_of(rows):
    """One row of each group of near duplicates, the one with the least id."""
    sets = [shingles(r.text, 5) for r in rows]

    def linked(a, b):
        o = len(a & b)
        return bool(a) and bool(b) and 100 * o >= 80 * (len(a) + len(b) - o)

    tops = groups(sets, linked)
    least = {}
    for r, t in zip(rows, tops):
        least[t] = min(least.get(t, float("inf")), float("inf") if r.doc_id is None else r.doc_id)
    return tops, least


def test_stages_follow_one_another(spark, sf):
    docs = common.read(spark, sf, "documents")
    first = corpus_pipeline.quality_rules(spark, docs, sf)
    field = quality.fit(docs, common.read(spark, sf, "labels"))
    good = {r.doc_id for r in quality.judge(docs, field).where("kept").collect()}
    rows = first.collect()
    assert first.columns == docs.columns and {r.doc_id for r in rows} == good

    second = corpus_pipeline.near_duplicates(spark, first, sf)
    left = second.collect()
    tops, least = kept_of(rows)
    assert second.columns == docs.columns and sorted(r.doc_id for r in left) == sorted(least.values())

    third = corpus_pipeline.personal_data(spark, second, sf)
    masked = {r.doc_id: r for r in third.collect()}
    assert third.columns == docs.columns and masked.keys() == {r.doc_id for r in left}
    for r in left:
        assert masked[r.doc_id].text == pii.masked(r.text) and pii.find(masked[r.doc_id].text)[0] == []
        assert masked[r.doc_id].n_chars == (r.n_chars if masked[r.doc_id].text == r.text else len(masked[r.doc_id].text))

    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(k, np.array(model.encode(r.text, add_special_tokens=False).ids + [0], "<u4")) for k, r in masked.items()]
    pieces = corpus_pipeline.run(spark, sf).collect()
    check_packing(pieces, ids)
    assert {r.doc_id for r in pieces} == masked.keys()


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, sf, no_docs, stage):
    assert stage(spark, no_docs, sf).count() == 0


def test_stages_take_odd_rows(spark, sf, odd_docs):
    before = odd_docs.collect()
    assert all(r.doc_id == 6 or len((r.text or "").split()) >= 50 for r in corpus_pipeline.quality_rules(spark, odd_docs, sf).collect())
    left = corpus_pipeline.near_duplicates(spark, odd_docs, sf)
    tops, least = kept_of(before)
    rows = left.collect()
    # Rows without words stay; of the others one per group, the missing id behind the others.
    assert left.columns == odd_docs.columns
    blank = [r for r in before if not (r.text or "").split()]
    assert Counter(r.doc_id for r in rows) == Counter([r.doc_id for r in blank] + [least[t] for t in {t for r, t in zip(before, tops) if (r.text or "").split()}])
    assert corpus_pipeline.personal_data(spark, odd_docs, sf).count() == len(before)
    assert corpus_pipeline.pack_windows(spark, odd_docs, sf).select("doc_id").distinct().count() == len({r.doc_id for r in before})

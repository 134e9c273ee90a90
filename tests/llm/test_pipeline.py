"""The pipeline against a brute-force version of its stages on a small corpus."""

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from parlance.llm import decontam, toxicity

from .conftest import prose
from .test_dedup import slow_fingerprint, slow_groups
from .test_models import slow_quality

ITEM = prose(900, 30)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    docs = [(i, prose(i, 70 + i % 20)) for i in range(80)]
    docs += [(100 + i, prose(i, 70 + i % 20).replace(" ", "  \n")) for i in range(0, 80, 4)]      # copies
    docs += [(200 + i, prose(300 + i, 60) + " you moron scum " + prose(400 + i, 20)) for i in range(20)]
    docs += [(300 + i, prose(500 + i, 50) + "\n" + ITEM.upper() + " " + prose(600 + i, 20)) for i in range(5)]
    docs += [(400, None), (401, ""), (402, "short text"), (403, " ".join(["%%% the of"] * 40)), (404, "same words here " * 60)]
    labels = [(i, 0) for i in range(0, 80)] + [(200 + i, 1) for i in range(0, 20)] + [(None, 1), (5, None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "src", 1) for i, t in docs], "doc_id long, text string, lang string, ids string, "
                          "n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs


def test_run_is_the_stages_by_brute_force(spark, corpus):
    folder, docs = corpus
    score = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"),
                           spark.read.parquet(f"{folder}/labels.parquet")).scorer()
    left = [(i, t) for i, t in docs if score([t or ""])[0] < 0.5]
    assert not {i for i, _ in left} & set(range(200, 220)) and len(left) > 100          # toxic ones went, clean ones stay
    def good(t):
        words, _, symbols, _, repeats = slow_quality(t)
        return words >= 50 and 100 * repeats <= 50 * words and symbols <= 0.1 * words
    left = [(i, t) for i, t in left if good(t)]
    groups = slow_groups([slow_fingerprint(t) for _, t in left], 2)
    least = {}
    for (i, _), g in zip(left, groups):
        least[g] = min(i, least.get(g, i))
    left = [(i, t) for (i, t), g in zip(left, groups) if least[g] == i]
    normal = decontam.Normal()
    plain = lambda t: "".join(map(chr, normal(t)[0]))
    left = [(i, t) for i, t in left if plain(ITEM) not in plain(t)]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECES))

    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "text", "lang", "ids", "n_chars", "ids_", "round_trip"]
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in left)
    assert all(list(r.ids_) == lib.encode(r.text) and r.round_trip for r in rows)
    assert {r.doc_id for r in rows} == set(range(80))


def test_stages_keep_the_columns_and_take_an_empty_table(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, folder)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, folder).count() == 0

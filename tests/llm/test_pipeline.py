"""The pipeline's stages on a small folder."""

import random
import re

import pytest

import corpus_pipeline as cp
from rankloom.llm import language_id

pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STEMS = {"en": ["the", "and", "ing", "tion"], "de": ["sch", "ung", "über", "ein"], "fr": ["eau", "que", "é", "ment"]}


def text(rng, lang, n):
    return " ".join(rng.choice(STEMS[lang]) + rng.choice(STEMS[lang]) + rng.choice(["", "a", "o"]) + str(rng.randrange(9999)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(0)
    rows = []
    for i in range(150):
        lang = rng.choice(list(STEMS))
        rows.append((i, text(rng, lang, rng.randint(30, 120)), lang, f"src{i % 4}"))
    passage = text(rng, "en", 60)
    rows += [(200, rows[3][1], "en", "src0"), (201, rows[3][1] + " extra", "en", "src1")]  # copies of 3
    rows += [(210 + i, text(rng, "en", 80) + " " + passage + " " + text(rng, "en", 40), "en", "src2") for i in range(3)]
    rows += [(300, "12 34 !!", None, "src3"), (301, None, None, None), (302, "", "en", "src1")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, passage


def test_stages(spark, folder, tmp_path):
    path, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, at = docs.columns, {}
    for i, (name, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        at[name] = docs
        if i < len(cp.STAGES) - 1:
            assert docs.columns == columns
    ids = lambda n: {r["doc_id"] for r in at[n].select("doc_id").collect()}
    assert not {300, 301, 302} & ids("language_id") and len(ids("language_id")) >= 150
    assert ids("near_copies") == ids("language_id") - {200, 201}
    assert ids("repeated_passages") == ids("near_copies")
    texts = {r["doc_id"]: r["text"] for r in at["repeated_passages"].collect()}
    held = [sum(w in texts[210 + i].split() for w in passage.split()) for i in range(3)]
    assert held[0] == 60 and max(held[1:]) < 30
    mixed = at["mixture"].groupBy("doc_id").count().collect()
    assert max(r["count"] for r in mixed) <= 2
    assert at["packing"].agg({"length": "sum"}).first()[0] > 0


def test_run(spark, folder):
    assert cp.run(spark, folder[0]).count() > 0 and cp.ORACLE_SQL is None
    assert language_id.train(spark.read.parquet(f"{folder[0]}/documents.parquet")).languages == ("de", "en", "fr")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


def test_empty_table(spark, tmp_path):
    assert cp.run(spark, written(spark, str(tmp_path), [])).count() == 0


def test_ties_and_shared_ids(spark, tmp_path):
    """Equal texts, one doc_id with several texts and rows without an id go through all stages, and no text is lost."""
    rng = random.Random(4)
    base = [text(rng, "en", 60) for _ in range(40)] + [text(rng, "de", 60) for _ in range(40)]
    rows = [(i, t, "en" if i < 40 else "de", "s", len(t)) for i, t in enumerate(base)]
    extra = [text(rng, "en", 70) for _ in range(3)]
    rows += [(5, extra[0], "en", "s", 1), (5, extra[1], "en", None, 1), (None, extra[2], "en", "s", 1), (7, base[7], "en", "s", 1), (90, base[8], "en", "s", 1)]
    path = written(spark, str(tmp_path), rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = cp.repeated_passages(spark, cp.near_copies(spark, docs, path), path).collect()
    assert sorted(r["text"] for r in kept) == sorted([*base, *extra])
    packed = cp.run(spark, path)
    assert packed.where("doc_id = 5").select("doc_tokens").distinct().count() >= 1
    assert packed.agg({"length": "sum"}).first()[0] > 80 * 60

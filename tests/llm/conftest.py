from __future__ import annotations

import random

import pytest

WORDS = [a + b + c for a in ("ta", "lo", "mi", "ren", "sul") for b in ("ka", "dor", "vi", "ple") for c in ("n", "st", "ra", "mo", "xel")]

#: Columns of documents and some more whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, `key` long, text_hash long, bands array<long>, spans string, tag long, id long, score double, lang_pred string, token_ids string, `odd.name` string, _changed string, _id long, _Null string, _hash string, _told string, _lang string, _sure string, dup_spans string, DUP_doc string, dup_tag string, lang_score string"


def rows(texts):
    return [(i, t, lang, "s", None if t is None else len(t), 1, 2, 3, [4], "5", 6, 7, 0.5, "x", "y", "o", "c", 8, "n", "h", "t", "l", "s", "d", "e", "f", "g") for i, t, lang in texts]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.7 else "") for _ in range(n))


def edge_texts() -> list[tuple[int | None, str | None, str | None]]:
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    long = prose(2, 60_000)
    return [
        (1, base, "en"), (2, base, "en"), (2, base, "en"), (3, near, "en"), (4, None, "en"), (5, "", None), (6, " \t\n ", "en"), (7, "word", "en"), (8, "WORD", "de"), (None, prose(3, 90), "en"), (9, long, "en"),
        (10, prose(4, 70) + " " + base, None), (11, "é漢字🙂\x1c\x85\xa0²", "zz"), (12, "123 456 !!", "en"), (2, prose(5, 30), "en"), (13, None, None), (14, "'s don't  \r\n\r\n x", "en"), (15, "a<|endoftext|>b <|endoftext|>", "en"), (16, "ab" * 15_000, "en"),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(edge_texts()), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A folder like the driver's, of the edge cases: documents, labels, benchmark, embeddings."""
    d = tmp_path_factory.mktemp("edge")
    spark.createDataFrame(rows(edge_texts()), SCHEMA).coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (7, 0, 1), (7, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    bench = [(1, " ".join(prose(4, 70).split()[:14])), (2, "word"), (3, None), (4, "..."), (2, "absent words here"), (None, " ".join(prose(4, 70).split()[:12]))]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return str(d)

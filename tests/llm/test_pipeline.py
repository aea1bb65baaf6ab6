"""The pipeline's stages on a small corpus, each against what it must do."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    r = random.Random(11)
    words = [a + b + c for a in "bdfgklmprst" for b in "aeiou" for c in ("n", "r", "st", "mp", "l")]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    text = lambda n: "\n".join(line(12) for _ in range(n))
    item = line(30)
    base = text(12).split("\n")
    near = [" ".join(x.split()[:-1] + ["other"]) if i == 4 else x for i, x in enumerate(base)]
    near = "\n".join(f"{x} " + ("" if i != 4 else "") for i, x in enumerate(near))
    clean = {i: text(8) for i in range(1, 21)}
    shared = clean[1].split("\n")[0]
    docs = clean | {30: "1234 5678 !!", 31: None, 32: clean[2], 33: text(3) + "\n" + shared, 34: " ".join(base), 35: " ".join(near.split()), 36: line(60) + " " + item + " " + line(40)}
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = d.columns
        out = stage(spark, d, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        kept.append({x["doc_id"]: x for x in d.collect()})
    language, lines, copies, leaks = kept
    assert set(language) == set(docs) - {30, 31}
    assert set(lines) == set(language) - {32}
    assert lines[33]["text"] == docs[33].rpartition("\n")[0] and lines[33]["n_chars"] == len(lines[33]["text"])
    assert all(lines[i]["text"] == t for i, t in clean.items())
    assert set(copies) == set(lines) - {35}
    assert set(leaks) == set(copies) - {36}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, x in leaks.items():
        ids = np.array([*tokenizer.encode(x["text"], add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))}
    got = corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).collect()
    assert {tuple(x)[:5] for x in got} == want and len(got) == len(want)


def test_near_copies_between_the_limits(spark):
    words = [f"w{i}" for i in range(200)]
    edited = [f"other{i}" if i in (30, 70, 110, 150) else w for i, w in enumerate(words)]
    further = [f"more{i}" if i in (20, 50, 80, 120, 160) else w for i, w in enumerate(words)]
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(further))], "doc_id long, text string")
    # Five-word Jaccard to the first: 176/216 = 0.815 and 171/221 = 0.774; four-word: 181/213 = 0.8498.
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, d, "").collect()) == [1, 3]


def test_stages_on_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, "some words that no document of this test holds anywhere at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, line int, component_id string, item_id string, version string, rep string"
    text = "the same words stand here more than once in this table"
    rows = [(i, text if i % 2 else f"eine ganz andere zeile mit der nummer {i} steht hier", "en" if i % 2 else "de", "s", 1, 9, "c", "i", "v", "r") for i in range(12)]
    rows += [(None, "a text without a number", "en", None, None, None, None, None, None, None), (3, text, "en", "s", 1, 9, "c", "i", "v", "r"), (40, None, None, None, None, None, None, None, None, None), (41, "", "en", "s", 0, 0, "", "", "", "")]
    for name, table in (("full", rows), ("empty", [])):
        d = spark.createDataFrame(table, schema)
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, str(tmp_path))
            assert out.columns == d.columns
            path = str(tmp_path / f"{name}-{stage_name}")
            out.write.parquet(path)
            d = spark.read.schema(schema).parquet(path)
        kept = d.collect()
        assert len(kept) == (0 if name == "empty" else len(kept)) and all(r["rep"] in ("r", None) for r in kept)
        if table:
            assert {1, None} <= {r["doc_id"] for r in kept} and not {40, 41} & {r["doc_id"] for r in kept}
        assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).count() == len(kept)


def test_lines_of_a_table_without_a_count_of_characters(spark):
    docs = spark.createDataFrame([(1, "a line that stands twice\nand one that does not"), (2, "a line that stands twice")], "doc_id long, text string")
    assert [tuple(r) for r in corpus_pipeline.lines(spark, docs, "").collect()] == [(1, "a line that stands twice\nand one that does not")]

"""Bounds of the encoders' memory, very long texts and vocabularies that don't fit."""

import json
import random

import numpy as np
import pytest

from txsieve.llm import bpe, wavelet


@pytest.fixture(scope="module")
def stored():
    with open(bpe.vocabulary_path(), encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_distinct_units_stay_within_the_bound(stored, monkeypatch):
    """Two million distinct words: every table starts again before it is over its bound by more than a run adds."""
    monkeypatch.setattr(bpe, "TABLE_BYTES", 8 << 20)
    units = bpe.UnitTable(bpe.TrieCoder(stored), 8 << 20)
    vocabulary = units.encode_units.vocabulary
    run = bpe.RUN_CHARACTERS * 40
    for start in range(0, 2_000_000, 100_000):
        text = " ".join(np.base_repr(i * 7919, 36) for i in range(start, start + 100_000))
        flat, counts = units.encode([text])
        assert int(counts[0]) == len(flat)
        assert units.bytes <= (8 << 20) + run
        facts = len(vocabulary.fits) + len(vocabulary.steps) + 3 * len(vocabulary.suffixes)
        assert facts * bpe._FACT_COST <= (8 << 20) + run
        assert len(vocabulary.ends) == len(vocabulary.suffixes) == len(vocabulary.suffix_number)
    assert units.encode_units.vocabulary.decode(flat.tolist()) == text


def test_a_text_of_megabytes_in_runs_equals_the_library(stored, library, monkeypatch):
    monkeypatch.setattr(bpe, "RUN_CHARACTERS", 5000)
    draw = random.Random(5)
    pieces = [" the", "  ", "\n\n", " tion's", "x", "　", " 12345", "é", "<|endoftext|>", "\t", " of,", "日本"]
    texts = ["".join(draw.choice(pieces) for _ in range(n)) for n in (1_000_000, 3, 0, 4000, 200_000, 1)] + ["x" * 30_000, " " * 20_000, ""]
    for coder in (bpe.TrieCoder(stored), wavelet.LibraryCoder(stored)):
        flat, counts = bpe.UnitTable(coder).encode(texts)
        got = np.split(flat, np.cumsum(counts)[:-1])
        assert [g.tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_text_codes_and_decodes(spark, library):
    text = "naïve words, 1234 of <|endoftext|> them\n" * 80_000
    frame = spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string")
    rows = bpe.encode_documents(frame).filter("doc_id = 1").collect()
    assert [r.ids for r in rows] == [library.encode(text, add_special_tokens=False).ids] * 2
    assert {r.decoded for r in bpe.decode_documents(bpe.encode_documents(frame)).collect()} == {text, ""}


def test_ids_beyond_the_levels_are_refused(spark, stored, tmp_path, folder):
    """A vocabulary with an id above 65,535 raises instead of writing other ids."""
    wide = json.loads(stored)
    moved = wide["model"]["vocab"].pop("Ġthe")
    wide["model"]["vocab"]["Ġthe"] = moved + 70_000
    path = tmp_path / "wide.json"
    path.write_text(json.dumps(wide), encoding="utf-8")
    frame = spark.createDataFrame([(1, "in the end")], "doc_id long, text string")
    with pytest.raises(Exception, match="more bits than there are levels"):
        wavelet.write_archive(frame, folder("wide"), str(path))


def test_empty_table(spark, folder):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.code_digests(frame).collect() == []
    place = folder("none")
    wavelet.write_archive(frame, place)
    assert wavelet.read_archive(spark, place).collect() == []

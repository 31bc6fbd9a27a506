"""Each registered query of the subpackage on the smallest tables: against its SQL, else its columns and rows."""

import glob
import os
import zlib

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import quality
from ledgerloom.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10_quality": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    found = df.collect()
    if name not in SQL:
        assert df.columns == COLUMNS[name]
        ids = sorted(r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{DATA}/documents.parquet'").fetchall())
        assert sorted({r.doc_id for r in found}) == ids and (name == "op1_packing" or len(found) == len(ids))
        if "held_out" in df.columns:
            assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % (10 if name == "op7_lm_scoring" else 5) == 0) for r in found)
        return
    columns = sorted(df.columns)
    with duckdb.connect() as con:
        for path in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
        want = con.execute(SQL[name])
        names = [d[0] for d in want.description]
        rows = [tuple(r[names.index(c)] for c in columns) for r in want.fetchall()]
    assert columns == sorted(names) and sorted((tuple(r[c] for c in columns) for r in found), key=repr) == sorted(rows, key=repr)


def test_quality_without_the_dealt_signal_is_chance():
    """Both dictionaries alike: no text differs from another, whatever it is."""
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"abc " if k % 2 else b"XYZ!"), 400).astype(np.uint8)) for k in range(400)]
    model = quality.QualityModel(texts, np.array([k % 2 for k in range(400)], dtype=float))
    model.good = model.bad
    x = model.compressors().features(texts)
    assert not x.any() and len(set(model.calibration(x))) == 1


def test_quality_score_equals_compressed_sizes():
    """The features against compressing each block anew."""
    import zstandard

    texts = [b"good words here " * 90, b"", b"%%% !!! " * 200, b"good %%% " * 10]
    model = quality.QualityModel([t for t in texts if t] * 60, np.array([1.0, 0.0, 1.0] * 60))
    for text, row in zip(texts, model.compressors().features(texts), strict=True):
        sizes = []
        for data in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(text[k : k + quality.BLOCK])) for k in range(0, len(text), quality.BLOCK)))
        good, bad = sizes
        assert row == pytest.approx([(bad - good) / max(1, len(text)), (bad - good) / max(1, min(good, bad)), np.log((bad + 1) / (good + 1))])

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortfold.llm import queries, token_files

tokenizers = pytest.importorskip("tokenizers")
FILE = queries.tokenizer_file()
SF = "/root/testdata/sf0.001"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab's.,!é1!日 \n\t\x0b\x1c\x85\u00a0\u2003\u2028😀")), max_size=30), max_size=6), st.sampled_from([1, 7, 1 << 20]))
def test_encoder_equals_the_tokenizer(texts, chunk):
    encoder = token_files.Encoder.__new__(token_files.Encoder)
    encoder.__dict__ |= token_files._encoder(FILE).__dict__ | {"_chunk": chunk}
    fresh = tokenizers.Tokenizer.from_file(FILE)
    assert [x.tolist() for x in encoder.encode(texts)] == [x.ids for x in fresh.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("remembered", [0, 2000, 1 << 20])
def test_encoder_forgets(remembered):
    encoder = token_files.Encoder(FILE, remembered=remembered, chunk=50)
    fresh = tokenizers.Tokenizer.from_file(FILE)
    words = [f"w{i}x" for i in range(3000)]
    for text in ("a b c d e f", "a b <|endoftext|> c", "<|endoftext|>", "x<|endoftext|>\n\n<|endoftext|>", "it's they'll 12 x  y", " ".join(words), "Zoë. " * 50):
        assert encoder.encode([text, None, text])[0].tolist() == fresh.encode(text, add_special_tokens=False).ids
        if remembered < 1 << 20:
            assert encoder._known.bytes <= remembered + 50 * (token_files._ENTRY + 20)  # that of one chunk more


def test_equal_hashes_are_compared_by_their_bytes(monkeypatch):
    monkeypatch.setattr(token_files, "_BYTE_CODE", np.ones(256, np.uint64))
    fresh = tokenizers.Tokenizer.from_file(FILE)
    text = "ab ba cab abc ab bb\nab ba. ab, é ab"
    assert token_files.Encoder(FILE).encode([text, text[::-1]])[0].tolist() == fresh.encode(text, add_special_tokens=False).ids


def test_added_tokens_that_reach_their_neighbours_or_hold_letters_only(tmp_path):
    own = tokenizers.Tokenizer.from_file(FILE)
    own.add_tokens([tokenizers.AddedToken("ponies", normalized=False), tokenizers.AddedToken("a. b", normalized=False), tokenizers.AddedToken("[x]", lstrip=True, rstrip=True, normalized=False)])
    file = str(tmp_path / "own.json")
    own.save(file)
    texts = ["my ponies run. ponies", "xa. b and a. b", "go [x] on [x]", "plain text", "", "a.  b"]
    assert [x.tolist() for x in token_files.Encoder(file).encode(texts)] == [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]


def want(docs):
    t, out, start = token_files.Encoder(FILE).tokenizer, [], 0
    for d, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(map(tuple, queries.op5_token_files(spark, SF).collect())) == want(docs)


def test_round_trip_edges_and_layout(spark, tmp_path):
    long = "lorem ipsum " * 50_000
    rows = [(5, "b", 1, "x"), (2, None, 2, "y"), (9, "", None, None), (3, long, 3, "z"), (7, " two  spaces \n", 4, "w"), (5, "b", 1, "x")]
    path = str(tmp_path / "tokens")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string, part int, ids string"), path, FILE)
    told = sorted(map(tuple, token_files.checksums(spark, path).collect()))
    assert told == sorted(want(sorted(((r[0], r[1]) for r in rows), key=lambda r: r[0])))
    files = sorted(f for f in tmp_path.glob("tokens/*.parquet"))
    assert len(files) > 1 and pq.ParquetFile(files[0]).schema_arrow.names == ["doc_id", "part", "part_start", "n_tokens", "ids"]
    encodings = set()
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            kinds = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert "DELTA_BINARY_PACKED" in kinds["doc_id"].encodings and kinds["doc_id"].has_offset_index
            encodings |= set(kinds["ids.list.element"].encodings)
    assert any("DICTIONARY" in e for e in encodings)  # short lists stay delta encoded
    one = token_files.read_tokens(spark, path).filter("doc_id = 7").select("ids").collect()
    assert one[0].ids[:-1] == token_files.Encoder(FILE).tokenizer.encode(rows[4][1], add_special_tokens=False).ids


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, FILE)
    assert token_files.checksums(spark, path).count() == 0


def test_added_tokens_are_encoded_as_the_unchanged_tokenizer_does():
    fresh = tokenizers.Tokenizer.from_file(FILE)
    added = [t.content for t in fresh.get_added_tokens_decoder().values()]
    texts = [text for a in added for text in (a, f"a b {a} c", f"x{a}y z", f"a  {a}{a} \n b", a[:-1] + " " + a[-1:], a.upper())] + ["plain words"]
    assert added and any(set(fresh.encode(t, add_special_tokens=False).ids) & set(fresh.get_added_tokens_decoder()) for t in texts)
    got = token_files.Encoder(FILE).encode(texts)
    assert [x.tolist() for x in got] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


def test_strings_are_remembered_in_little_space():
    encoder, learned = token_files.Encoder(FILE, remembered=1 << 20), []
    learn = encoder._learn
    encoder._learn = lambda *a: learned.append(len(a[0])) or learn(*a)
    text = " ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(9000))
    first = encoder.encode([text])[0]
    assert len(learned) == 1 and encoder.encode([text])[0].tolist() == first.tolist()
    assert len(learned) == 1

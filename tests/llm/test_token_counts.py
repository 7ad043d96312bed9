import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer, models

from formlens.llm.queries import op1_token_counts
from formlens.llm.token_counts import Unigram, _tokenizer, count_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def exact():
    """The same vocabulary in another library's unigram tokenizer."""
    sp, _ = _tokenizer(MODEL)
    return sp, Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], 0, True))


def test_query_counts_like_the_tokenizer(spark, exact):
    sp, other = exact
    want = {r["doc_id"]: len(other.encode(sp.normalize(r["text"] or "")).ids) if r["text"] else 0 for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()}
    assert {r.doc_id: r.n_tokens for r in op1_token_counts(spark, "/root/testdata/sf0.001").collect()} == want


def test_odd_texts(spark, exact):
    sp, other = exact
    texts = ["", None, " ", "   a   b", "\n\n\t x", "中文字 é́ 🙂🙂", "aaaa" * 300, "▁▁x▁", "x" * 9000 + " y", "the cat"] * 2
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, N_Tokens int")
    out = count_tokens(docs, MODEL)
    assert out.columns == ["doc_id", "text", "n_tokens", "best_score"]
    for r in out.collect():
        assert r.n_tokens == (len(other.encode(sp.normalize(r.text)).ids) if r.text else 0), r.text
    assert count_tokens(docs.limit(0), MODEL).count() == 0


@pytest.mark.parametrize("byte_pieces", [True, False])
@pytest.mark.parametrize("whole", [True, False])
def test_ties_and_rounding(whole, byte_pieces):
    rng = random.Random(4)
    for _ in range(60):
        pieces = {"".join(rng.choice("ab▁" if k == 0 else "ab") for k in range(rng.randint(1, 4))): -rng.randint(1, 6) * (1.0 if whole else 0.1) for _ in range(12)}
        least = min(pieces.values())
        raw = [(f"<0x{b:02X}>", least) for b in range(256)] if byte_pieces else []
        other = Tokenizer(models.Unigram([("<unk>", least), *raw, *pieces.items()], 0, byte_pieces))
        own = Unigram(pieces, least, byte_pieces)
        for _ in range(40):
            text = "".join(rng.choice("aab▁é") for _ in range(rng.randint(1, 60)))
            assert own(text)[0] == len(other.encode(text).ids), (text, pieces)

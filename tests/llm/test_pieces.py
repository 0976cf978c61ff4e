import hashlib

import numpy as np
import pytest
import sentencepiece

from lexweave.llm import pieces
from lexweave.llm.pieces import piece_model
from lexweave.llm.queries import op7_piece_codec

TEXTS = ["", " ", "a", "  two  spaces ", "tab\tand\nline", "▁ literal", "héllo wörld", "日本語 🙂", "x" * 5000, "a b " * 3000, None, "null\0byte", "a", "a"]


@pytest.fixture(scope="module")
def model():
    return piece_model()


def test_encoding_equals_the_library_and_spans_tile_the_text(spark, model):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    own = {r.doc_id: r for r in pieces.encode(df, model).collect()}
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert len(own) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_eos=True)
        r = own[i]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.n_source_bytes == len((t or "").encode())
        if r.ids[:-1]:
            assert r.starts[0] == 0 and r.ends[-1] == len((t or "").encode())


def test_spans_point_at_the_piece_in_the_source(model):
    tool = pieces.Codec(model)
    text = "The quick wörld 🙂 again"
    raw = np.frombuffer(text.encode(), np.uint8)
    ids = tool.processor.encode(text)
    for i, (a, b) in zip(ids, tool.spans(raw, ids)):
        if not tool.processor.is_byte(i):
            assert raw[a:b].tobytes().decode() == tool.processor.id_to_piece(i).replace("▁", " ").removeprefix(" " if a == 0 else "")


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "identity", "nfkc_cf"])
def test_character_maps_give_the_librarys_normal_form(rule):
    made = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    own = pieces.Normaliser(made.serialized_model_proto())
    for t in ["ﬁne  ＡＢＣ", " ㌔ x ", "é è", "½ ™ ①", "plain text", "", "   ", "カ゛ﾊﾟ", "tab\there"]:
        normal, source = own._general(t.encode())
        assert normal.decode() == made.normalize(t)
        assert len(source) == len(normal) + 1 and (np.diff(source) >= 0).all()


def with_rule(model, rule):
    """The model with another normaliser."""
    made = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    spec = next(v for n, v in pieces.fields(made.serialized_model_proto()) if n == 3)
    return b"".join(pieces.field(n, v) for n, v in pieces.fields(model) if n != 3) + pieces.field(3, spec)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_a_model_with_a_character_map_encodes_as_the_library_and_spans_follow_the_map(spark, model, rule):
    mapped = with_rule(model, rule)
    texts = ["ﬁne  ＡＢＣ", " ㌔ x ", "é è", "½ ™ ①", "plain text", "", "   ", "カ゛ﾊﾟ", "tab\there", None]
    rows = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), mapped).collect()
    library = sentencepiece.SentencePieceProcessor(model_proto=mapped)
    normaliser = pieces.Normaliser(mapped)
    tool = pieces.Codec(mapped)
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        assert r.ids == library.encode(text.decode(), add_eos=True)
        # Brute force: a byte of the normalised text came from the first source byte whose prefix it is not yet in.
        normal, source = normaliser._general(text)
        at = 0
        for i, a, b in zip(r.ids, r.starts, r.ends):
            n = len(tool.bytes[i])
            assert (a, b) == (source[at], source[at + n])
            at += n
        assert at == len(normal)


def test_every_text_of_a_table_has_the_librarys_ids(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in pieces.encode(docs, model, outputs=("ids", "starts", "ends")).collect():
        text = (texts[r.doc_id] or "").encode()
        assert r.ids == library.encode(text.decode(), add_eos=True)
        assert b"".join(text[a:b] for a, b in zip(r.starts, r.ends) if a < b).replace(b" ", b"") == text.replace(b" ", b"") or any(library.is_byte(i) for i in r.ids)


def test_an_empty_table_gives_no_row(spark, model):
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_clashing_names_are_refused(spark, model):
    with pytest.raises(ValueError):
        pieces.encode(spark.createDataFrame([], "ids long, text string"), model, keep=("ids",))


def test_query_round_trip(spark):
    rows = op7_piece_codec(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "sha2(coalesce(text, ''), 256) s", "octet_length(coalesce(text, '')) n")
    both = rows.join(docs, "doc_id")
    assert both.where("decoded_sha256 = s and n_source_bytes = n").count() == docs.count()


def test_pieces_of_other_bytes_are_refused():
    import numpy as np
    import pytest

    from lexweave.llm import pieces

    tool = pieces.codec(pieces.piece_model())
    text = np.frombuffer(b"the dog", np.uint8)
    tool.spans(text, tool.processor.encode("the dog"))
    with pytest.raises(ValueError):
        tool.spans(text, tool.processor.encode("the cat"))

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from refrain.llm import bytekit as B
from refrain.llm import pieces as P

TEXTS = ["", "Hello world", "  two  spaces ", "Überraschung\nmit 漢字 und 🙂 ", "a", " ", "tab\there", "x" * 3000, "é" * 700 + " end", "▁mark"]


def expected(model: P.Pieces, text: str) -> list[tuple[int, int]]:
    """The library's spans, which are in bytes."""
    return [(p.begin, p.end) for p in model.sp.encode(text, out_type="proto").pieces]


def trimming(rule: str) -> bytes:
    """The model with a map and with spaces at the ends and runs of spaces taken out."""
    out = []
    for number, value in P._fields(P.with_rule(open(P.MODEL, "rb").read(), rule)):
        if number == 3:
            spec = {**dict(P._fields(value)), 4: 1}
            value = b"".join(P._field(k, 2 if isinstance(v, bytes) else 0, v if isinstance(v, bytes) else v.to_bytes(8, "little")) for k, v in sorted(spec.items()))
        out.append(P._field(number, 2, value) if isinstance(value, bytes) else P._field(number, 0, value.to_bytes(8, "little")))
    return b"".join(out)


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("trim", [False, True])
def test_spans_with_a_map_equal_the_librarys(rule, trim):
    model = P.Pieces(proto=trimming(rule)) if trim else P.load(P.MODEL, rule)
    texts = [*TEXTS, "ﬁne ① ｶﾞ Ⅷ", "é combining é À́x", " ㍿ ½  ™ ", "각 한", "a b\tc  ", "\u200b", "   "]
    data, offs = B.flat(pa.array(texts))
    ids = model.sp.encode(texts)
    flat, counts, begins, ends = model.spans(texts, data, offs, ids)
    normal, _, _, _ = model.align_all(data, offs)
    assert normal.tobytes().decode() == "".join(model.sp.normalize(t) for t in texts)
    at = np.concatenate(([0], np.cumsum(counts)))
    for i, t in enumerate(texts):
        assert list(zip(begins[at[i] : at[i + 1]].tolist(), ends[at[i] : at[i + 1]].tolist())) == expected(model, t), t


def test_spans_equal_the_librarys():
    model = P.load(P.MODEL)
    data, offs = B.flat(pa.array(TEXTS))
    flat, counts, begins, ends = model.spans(TEXTS, data, offs, model.sp.encode(TEXTS))
    at = np.concatenate(([0], np.cumsum(counts)))
    for i, t in enumerate(TEXTS):
        assert list(zip(begins[at[i] : at[i + 1]].tolist(), ends[at[i] : at[i + 1]].tolist())) == expected(model, t), t


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
def test_alignment_by_a_compiled_map(rule):
    made = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = dict(P._fields(dict(P._fields(made.serialized_model_proto()))[3]))
    model = P.Pieces.__new__(P.Pieces)
    model.charmap, (model.prefix, model.trim, model.escape) = P.CharMap(spec.get(2, b"")), (bool(spec.get(k, 1)) for k in (3, 4, 5))
    for text in ["ﬁne ① ｶﾞ Ⅷ", "plain text", "é combining", "㍿ ½ ™", "a b\tc"]:
        data, source = model.align(text)
        assert data.decode() == made.normalize(text)
        assert source[-1] == len(text.encode()) and (np.diff(source) >= 0).all()


def test_query_shape_and_edge_cases(spark):
    rows = [(1, "Some text.", 1), (None, None, 2), (3, "", 3), (3, "", 3), (4, "long " * 40_000, 4), (5, "▁", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {(r.doc_id, i): r for i, r in enumerate(P.encode(df).collect())}
    by = {}
    for (k, _), r in got.items():
        by.setdefault(k, []).append(r)
    assert by[None][0].ids is None and by[None][0].roundtrip is None
    assert [list(r.ids) for r in by[3]] == [[], []] and by[3][0].roundtrip
    assert by[4][0].roundtrip and by[4][0].ends[-1] == 200_000
    assert by[5][0].roundtrip is False
    texts = {r.doc_id: r.text for r in P.decode(P.encode(df)).collect()}
    assert texts[1] == "Some text." and texts[None] is None and texts[3] == "" and texts[4] == "long " * 40_000
    assert P.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_all_documents_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = P.encode(docs).toPandas()
    assert len(out) == docs.count() and out.roundtrip.all()
    model = P.load(P.MODEL)
    for r in docs.limit(20).collect():
        row = out[out.doc_id == r.doc_id].iloc[0]
        assert list(zip(row.begins, row.ends)) == expected(model, r.text)

import os
from datetime import date, datetime
from decimal import Decimal
from xml.etree import ElementTree

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paylake import cli, queries
from paylake.errors import ExportError, render
from paylake.functions import casts, validators
from paylake.messages import NAMESPACES, pacs8
from paylake.operators.export import plan_blocks
from paylake.operators.verdict import failed_documents, report
from paylake.operators.extract import extract
from paylake.operators.xsd import GrammarError, load_grammar, violates
from paylake.plans.exporter import run_export
from paylake.plans.importer import run_import, store_in_batches
from paylake.queries import GRAMMAR
from paylake.schema import REPEATED, Field, Path, Schema, SchemaError, Segment
from paylake.sources import documents as D
from paylake.sources import cut as cut_module
from paylake.sources.columns import Columns
from paylake.sources.cut import Cutter, Shapes, compile_schema, cut, fault_at, rows_of_tag
from paylake.sources.publish import PublishError, staging_file
from paylake.streaming.inbox import watch

NS = NAMESPACES[""]
HEAD = "<x:GrpHdr><MsgId>M1</MsgId><NbOfTxs>{n}</NbOfTxs><x:TtlIntrBkSttlmAmt Ccy='EUR'>2.00</x:TtlIntrBkSttlmAmt></x:GrpHdr>"
TXN = "<CdtTrfTxInf><PmtId><TxId>{id}</TxId></PmtId><IntrBkSttlmAmt Ccy='EUR'>{amount}</IntrBkSttlmAmt><CdtrAcct><Id><IBAN>SI56010000000100090</IBAN></Id></CdtrAcct></CdtTrfTxInf>"


def doc(*inner, sep="\n"):
    return f"<Document xmlns='{NS}' xmlns:x='{NS}'>{sep}<FIToFICstmrCdtTrf>{sep}" + sep.join(inner) + f"{sep}</FIToFICstmrCdtTrf>{sep}</Document>"


def docs_of(spark, contents, agents=None):
    rows = [(k, agents[k] if agents else 1, c) for k, c in enumerate(contents)]
    return spark.createDataFrame(rows, "doc_ndx int, agent_id smallint, content string")


def schema(header=lambda: F.lit(True), txn=lambda: F.lit(True)):
    return pacs8(header, txn)


def cut_text(s, text):
    return list(Cutter(*compile_schema(s)).cut(text.encode() if text is not None else None))


# ---- declarations


def test_paths():
    p = Path.parse(" /x:a//b/@c/ ", {"": "u", "x": "v"})
    assert p == Path(("v}a", "u}b"), "c") and str(p) == "a/b/@c" and p.with_uris() == "{v}a/{u}b/@c"
    for bad in ("y:a", "", "a/@b/c", "a:b:c", "/".join("a" * 11)):
        with pytest.raises(SchemaError):
            Path.parse(bad, {"": "u"})


def test_schema_limits():
    f = Field("a", "t/a")
    for segments in ((), tuple(Segment(f"s{k}", "t", (f,)) for k in range(65)), (Segment("s", "t", ()),), (Segment("s", "t", (f, f)),), (Segment("s", "t", (Field("a", "u/a"),)),), (Segment("s", "t", (Field("a", "t/@a", cardinality=REPEATED),)),), (Segment("s", "t", (Field("a", "t/a", "float"),)),)):
        with pytest.raises(SchemaError):
            Schema({}, segments)


# ---- cutting


def test_cut_segments_and_raw():
    rows = cut_text(schema(), doc(HEAD.format(n=2), "<Other><CdtTrfTxInf/></Other>", TXN.format(id="a&amp;b", amount=1), TXN.format(id="c", amount=2)))
    assert [(r[0], r[1]) for r in rows] == [(0, "header"), (1, "txn"), (2, "txn")]
    assert rows[1][3][0] == ["a&b"] and rows[1][2].startswith("<PmtId>") and rows[1][2].endswith("</CdtTrfTxInf>")
    assert [r[1:4] for r in cut_text(schema(), doc(HEAD.format(n=2), TXN.format(id="c", amount=2), sep=""))] == [r[1:4] for r in cut_text(schema(), doc(HEAD.format(n=2), TXN.format(id="c", amount=2)))]


def test_cut_matches_uris_not_prefixes():
    assert [r[1] for r in cut_text(schema(), doc(TXN.format(id=1, amount=1)).replace("x:", "q:").replace(":x=", ":q="))] == ["txn"]
    assert cut_text(schema(), doc(TXN.format(id=1, amount=1)).replace(NS, "urn:other")) == []


def test_cut_faults_and_state():
    c = Cutter(*compile_schema(schema()))
    bad = list(c.cut(doc(HEAD.format(n=1)).replace("</Document>", "</BadClose>").encode()))
    assert [r[0] for r in bad] == [0, -1] and bad[1][4]["code"] == "syntax_error" and bad[1][4]["line"] == 5 and "BadClose" in bad[1][4]["context"]
    assert [r[0] for r in c.cut(doc(TXN.format(id=1, amount=1)).encode())] == [0]
    for empty in (None, "", "  "):
        assert [(r[0], r[4]["code"]) for r in cut_text(schema(), empty)] == [(-1, "xml_empty")]


def test_cut_text_rules():
    s = Schema({}, (Segment("t", "r/t", (Field("first", "t/a"), Field("second", "t/a"), Field("all", "t/b", cardinality=REPEATED), Field("at", "t/@k"))),))
    (row,) = cut_text(s, "<r><t k='&quot;>'> <a> 1 </a><a>2<i>x</i>3</a>" + "".join(f"<b>{k}</b>" for k in range(12)) + "<c/></t></r>")
    # of two fields with one path the last declared takes the first occurrence
    assert row[3] == [["23"], [" 1 "], [str(k) for k in range(10)], ['">']]
    (row,) = cut_text(s, "<r><t/></r>")
    assert row[2] == "" and row[3] == [[], [], [], []]


def test_cut_other_encoding(spark):
    s = Schema({}, (Segment("t", "r/t", (Field("a", "t/a"),)),))
    (row,) = Cutter(*compile_schema(s)).cut("<?xml version='1.0' encoding='ISO-8859-1'?><r><t><a>é</a></t></r>".encode("latin-1"))
    assert row[3] == [["é"]] and row[2] == "<a>é</a></t>"


# ---- casts and rules


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "cast, value, want",
    [
        (casts.amount, "123.4567899", Decimal("123.45678")), (casts.amount, "-5", Decimal(0)), (casts.amount, "7", Decimal(7)), (casts.amount, ".5", Decimal("0.5")), (casts.amount, "x", Decimal(0)), (casts.amount, None, None),
        (casts.big_int, "18446744073709551615", Decimal(2**64 - 1)), (casts.big_int, "18446744073709551616", Decimal(0)), (casts.big_int, "12a", Decimal(12)),
        (casts.int32, "-12.5", -12), (casts.int32, "+1", 0), (casts.int32, "2147483648", 0), (casts.int16, "40000", 0), (casts.int16, "", 0),
        (casts.date, "2024-02-29", date(2024, 2, 29)), (casts.date, "2023-02-29", None), (casts.date, "2024-01-02T03", date(2024, 1, 2)),
        (casts.timestamp, "2024-01-02T03:04:05.678+02:00", datetime(2024, 1, 2, 1, 4, 5, 678000)), (casts.timestamp, "2024-01-02T03:04:05", datetime(2024, 1, 2, 3, 4, 5)), (casts.timestamp, "2024-01-02T03:04:05.5Z", datetime(2024, 1, 2, 3, 4, 5, 500000)), (casts.timestamp, "nothing", None),
    ],
)
def test_casts(spark, cast, value, want):
    got = one(spark, lambda v: cast(v).cast("string"), value)
    shown = want.strftime("%Y-%m-%d %H:%M:%S.%f").rstrip("0").rstrip(".") if isinstance(want, datetime) else None if want is None else str(want)
    assert (Decimal(got) == want) if isinstance(want, Decimal) else got == shown


def test_iban(spark):
    rows = [("SI56010000000100090", True), ("si56010000000100090", False), ("SI56010000000100091", False), ("EE172303863092752160", False), ("DE89370400440532013000", True), ("GB82WEST12345698765432", True), ("XX12", False), ("SI56", False), ("", False), (None, False), ("GB82WEST1234569876543!", False)]
    df = spark.createDataFrame(rows, "v string, want boolean")
    assert df.where(validators.iban(F.col("v")) != F.col("want")).collect() == []
    assert one(spark, validators.iban_print, "si56 0100\t00000100090") == "SI56 0100 0000 0100 090"


@given(st.integers(0, 10**13 - 1))
def test_si_numbers_by_rule(n):
    assert 1 <= 98 - n * 100 % 97 <= 98


def test_validated_fields(spark):
    v = validators.amount_between(1, 10)
    s = Schema({}, (Segment("t", "t", (Field("a", "t/a", "amount", validator=v), Field("b", "t/b", "int", REPEATED, validators.member("1;2")), Field("c", "t/c", validator=validators.matches(validators.BIC, "bad_bic")))),))
    c = cut(spark.createDataFrame([(0, "<t><a>11</a><b>1</b><b>7</b><b>2</b><b>8</b><c>x</c></t>"), (1, "<t><a>2</a><c>BSLJSI2X</c></t>")], "doc_ndx int, content string"), s)
    x, y = extract(c, s, "t").orderBy("doc_ndx").collect()
    assert [e.domain_code for e in x.errors] == ["amount_out_of_range", "value_not_in_set", "value_not_in_set", "bad_bic"] and [e.path for e in x.errors][0] == "t/a"
    assert (x.a.value, x.a.error_idx, x.c.error_idx) == (None, 0, 3) and [(b.value, b.error_idx) for b in x.b] == [(1, None), (None, 1), (2, None), (None, 2)] and "'7'" in x.errors[1].message
    assert y.errors == [] and y.a.value == 2 and y.b == [] and (x.complete, y.complete) == (True, False)


# ---- runs


def test_import_verdicts(spark, tmp_path):
    good = doc(HEAD.format(n=2), TXN.format(id=1, amount=1), TXN.format(id=2, amount=60_000))
    texts = [good, good, good.replace("</Document>", "</Bad>"), doc(HEAD.format(n=1).replace("EUR", "USD"), TXN.format(id=3, amount=1)), doc(HEAD.format(n=9), TXN.format(id=4, amount=1)), doc(HEAD.format(n=6), *[TXN.format(id=k, amount=1) for k in range(6)]), doc(TXN.format(id=5, amount=1)), good]
    docs = docs_of(spark, texts, [1, 0, 1, 1, 1, 1, 1, None])
    grammar = tmp_path / "five.xsd"
    grammar.write_text(GRAMMAR.format(ns=NS, most=5).replace('name="GrpHdr" type="Any"', 'name="GrpHdr" type="Any" minOccurs="0"'))
    r = run_import(docs, schema(lambda: F.col("currency") == "EUR", lambda: F.size("errors") == 0), str(grammar), doc_rule=F.coalesce(F.col("declared") == F.col("n"), F.lit(True)), doc_aggs=(F.max("header__no_of_txn").alias("declared"), F.count_if(F.col("kind") == "txn").alias("n")))
    got = {d.doc_ndx: (d.error_mask, d.rejected, d.total, d.ok, d.error, d.stored) for d in r.documents.collect()}
    assert got == {0: (16, False, 3, 2, 1, 2), 1: (1, True, 0, 0, 0, 0), 2: (2, True, 0, 0, 0, 0), 3: (8, True, 2, 0, 2, 0), 4: (8, True, 2, 2, 0, 0), 5: (4, True, 0, 0, 0, 0), 6: (0, False, 1, 1, 0, 1), 7: (16, False, 3, 2, 1, 2)}
    assert {(x.doc_ndx, x.txn_id) for x in r.stored("txn").collect()} == {(0, "1"), (6, "5"), (7, "1")}
    assert {x.doc_ndx for x in r.failed("txn").where("status = 'skipped'").collect()} == {2, 3, 5}
    assert {d.doc_ndx for d in failed_documents(r.documents).collect()} == {2, 5}
    t = r.totals().first()
    assert (t.docs, t.total_segments, t.ok_segments, t.syntactically_correct, t.semantically_correct, t.rejected) == (8, 11, 7, 5, 2, 5)
    assert "rejected" in report(r.documents)
    assert run_import(docs.limit(0), schema()).totals().first().docs == 0


def test_fragments_are_documents(spark):
    s = schema()
    text = doc(HEAD.format(n=1), TXN.format(id="a&amp;b", amount=1)).replace("<Document ", "<Document xmlns:y='urn:y&amp;z' ")
    for row in cut_text(s, text):
        root = ElementTree.fromstring(row[6] + row[2])
        assert root.tag.startswith("{" + NS + "}")
    (row,) = cut_text(Schema({}, (Segment("t", "r/t", (Field("a", "t/@a"),)),)), "<r xmlns:p='u' xmlns:q='v'><t a='1' xmlns:p='w'/></r>")
    assert ElementTree.fromstring(row[6] + row[2]).attrib == {"a": "1"} and 'xmlns:q="v"' in row[6] and row[6].count("xmlns:p") == 1
    assert [r[5] for r in cut_text(s, doc(HEAD.format(n=2), TXN.format(id=1, amount=1), TXN.format(id=2, amount=2)).replace("</Document>", "</Bad>"))] == [False, False, True, None]


def test_cut_encodings(spark):
    s = Schema({}, (Segment("t", "r/t", (Field("a", "t/a"),)),))
    text = "<?xml version='1.0' encoding='{}'?><r><t><a>é東</a></t></r>"
    (row,) = Cutter(*compile_schema(s)).cut(text.format("UTF-16").encode("utf-16"))
    assert row[2:4] == ("<a>é東</a></t>", [["é東"]])
    c = cut(spark.createDataFrame([(0, text.format("ISO-8859-1"))], "doc_ndx int, content string"), s)
    assert [(r.raw, r.vals) for r in c.collect()] == [("<a>é東</a></t>", [["é東"]])]


def test_last_word_and_batches(spark):
    good = doc(HEAD.format(n=2), TXN.format(id=1, amount=1), TXN.format(id=2, amount=60_000))
    r = run_import(docs_of(spark, [good, good, good.replace("</Document>", "</B>")]), schema(txn=lambda: F.size("errors") == 0), final_ok=F.col("doc_ndx") != 1)
    assert {d.doc_ndx: (d.rejected, d.stored, d.reason) for d in r.documents.collect() if d.doc_ndx < 2} == {0: (False, 2, None), 1: (True, 0, "rejected at the end")}
    assert [x.doc_ndx for x in r.stored("txn").collect()] == [0]
    out = r.store("txn", lambda rows: None, lambda rows: None).collect()
    assert sum(x.rows for x in out) == 1 + r.failed("txn").count()


def test_grammars_of_one_name_and_unknown_agents(spark, tmp_path):
    names = []
    for most in (1, 9):
        (tmp_path / str(most)).mkdir()
        (tmp_path / str(most) / "g.xsd").write_text(GRAMMAR.format(ns=NS, most=most))
        names.append(load_grammar(spark, str(tmp_path / str(most) / "g.xsd")))
    two = doc(HEAD.format(n=2), TXN.format(id=1, amount=1), TXN.format(id=2, amount=2))
    docs = docs_of(spark, [two, two], [1, 0])
    assert docs.where("agent_id = 1").select(*[violates(F.col("content"), n).alias(n[8:12] + str(k)) for k, n in enumerate(names)]).first()[:] == (True, False)
    r = run_import(docs, schema(), str(tmp_path / "1" / "g.xsd"))
    assert {d.doc_ndx: (d.error_mask, d.xsd_invalid) for d in r.documents.collect()} == {0: (4, True), 1: (1, False)}


def test_document_paths(spark, tmp_path):
    for name in ("z[1].xml", "a b.xml", "c+d%20.xml"):
        (tmp_path / name).write_text(f"<{name[0]}/>")
    paths = [str(tmp_path / n) for n in ("z[1].xml", "a b.xml", "z[1].xml", "c+d%20.xml")]
    got = D.document_set(spark, paths).orderBy("doc_ndx").collect()
    assert [bytes(r.content or b"") for r in got] == [b"<z/>", b"<a/>", b"<z/>", b"<c/>"]
    with pytest.raises(D.DocumentError):
        D.document_set(spark, ["file:///nowhere/at/all.xml"])
    table = spark.createDataFrame([("k1", 7), ("k1", 7), ("k2", None)], "key string, agent int")
    docs = spark.createDataFrame([("k1", 0), ("k3", 0), ("k2", 0)], "key string, agent_id smallint")
    assert {r.key: r.agent_id for r in D.agents_from(table, "key", "agent")(docs).collect()} == {"k1": 7, "k2": 0, "k3": 0}


def test_grammar_states(spark, tmp_path):
    assert load_grammar(spark, str(tmp_path / "none.xsd")) is None
    (tmp_path / "bad.xsd").write_text("<nothing/>")
    with pytest.raises(GrammarError):
        load_grammar(spark, str(tmp_path / "bad.xsd"))


def test_batches(spark):
    df = spark.range(0, 10, 1, 1)

    def fail(rows):
        assert len(rows) <= 4
        if rows[0].id == 4:
            raise ValueError("full")

    assert [(r.rows, r.error) for r in store_in_batches(df, fail, 4, stop_on_error=False).collect()] == [(4, None), (4, "ValueError: full"), (2, None)]


def test_document_sets(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.xml").write_text(f"<d{k}/>")
    paths = [str(tmp_path / f"{k}.xml") for k in (2, 0, 1)]
    got = D.document_set(spark, paths, [0, 77, 0], lambda p: F.when(p.endswith("1.xml"), 5)).orderBy("doc_ndx").collect()
    assert [(r.out_doc_id, r.agent_id, bytes(r.content)) for r in got] == [(1, None, b"<d2/>"), (77, None, b"<d0/>"), (3, 5, b"<d1/>")]
    assert {r.agent_id for r in D.document_set(spark, paths).collect()} == {0}
    with pytest.raises(D.DocumentError):
        D.document_set(spark, ["/nowhere.xml"])
    assert D.split_arguments(["a.xml", "b.xsd"]) == ([os.path.abspath("a.xml")], os.path.abspath("b.xsd"))
    (tmp_path / "b.json").write_text('[{"name": "n", "bank_id": "01", "bic": "B", "iban": "I"}]')
    assert tuple(D.reference_list(spark, str(tmp_path / "b.json")).first()) == ("n", "01", "B", "I")
    assert rows_of_tag(spark, paths[0], "d2", "a string").count() <= 1


@pytest.mark.parametrize("sizes, most, want", [([3], 2, 2), ([23, 23], 5, 10), ([37], 3, 13), ([9] * 5, 4, 15), ([2], 10, 1)])
def test_export(spark, tmp_path, sizes, most, want):
    drains = spark.createDataFrame([(k, f"d{k}", most, 5) for k in range(len(sizes))], "drain_id int, name string, max_doc_txn long, existing long")
    txns = spark.createDataFrame([(k, 100 * k + j) for k, n in enumerate(sizes) for j in range(n)], "drain_id int, id long")
    m = run_export(txns, drains, str(tmp_path), lambda: F.concat(F.lit("<txn>"), F.col("id").cast("string"), F.lit("</txn>")), F.lit("<doc>"), F.lit("</doc>")).collect()
    assert len(m) == want and sum(r.n_txn for r in m) == sum(sizes) and min(r.doc_id for r in m) == 6
    assert sorted(os.listdir(tmp_path)) == sorted(r.doc_name for r in m)
    first = next(r for r in m if (r.drain_id, r.doc_id) == (0, 6))
    assert (tmp_path / first.doc_name).read_text() == "<doc>" + "".join(f"<txn>{j}</txn>" for j in range(min(most, sizes[0]))) + "</doc>"


def test_export_faults(spark, tmp_path):
    drains = spark.createDataFrame([(1, "d", 2, 0)], "drain_id int, name string, max_doc_txn long, existing long")
    txns = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "drain_id int, id long")
    with pytest.raises(ExportError, match="invalid_config"):
        run_export(txns, drains.limit(0), str(tmp_path), lambda: F.lit("x"))
    with pytest.raises(Exception, match="prepare_transaction_failed"):
        run_export(txns, drains, str(tmp_path), lambda: F.when(F.col("id") != 3, "x"))
    with pytest.raises(ExportError, match="document_rejected"):
        run_export(txns, drains, str(tmp_path), lambda: F.lit("x"), document_prepared=F.col("n_txn") > 1)
    with pytest.raises(Exception, match="prepare_header_failed"):
        run_export(txns, drains, str(tmp_path), lambda: F.lit("x"), F.repeat(F.lit("h"), 3000), header_limit=2048)
    assert os.listdir(tmp_path) == []
    assert plan_blocks(txns.limit(0), drains).collect() == []


def test_staging_names(tmp_path):
    final = str(tmp_path / "doc_1.xml")
    assert [staging_file(final).removeprefix(final) for _ in range(10)] == [".tmp", *[f".tmp{k}" for k in range(1, 10)]]
    with pytest.raises(PublishError, match="file_rename_collision"):
        staging_file(final)


def test_cli_and_stream(spark, tmp_path):
    out = tmp_path / "in"
    out.mkdir()
    assert cli.main(["gen", "--transactions", "30", "--per-document", "10", "--out", str(out)], spark) == 0
    grammar = tmp_path / "g.xsd"
    grammar.write_text(GRAMMAR.format(ns=NS, most=10))
    files = sorted(str(out / f) for f in os.listdir(out))
    assert len(files) == 3 and cli.main(["validate", *files, str(grammar), "-q"], spark) == 0
    grammar2 = tmp_path / "h.xsd"
    grammar2.write_text(GRAMMAR.format(ns=NS, most=9))
    assert cli.main(["validate", *files, str(grammar2)], spark) == 1 and cli.main(["validate", *files], spark) == 1
    assert cli.main(["import", str(out), "--out", str(tmp_path / "t")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "t/txn")).count() + spark.read.parquet(str(tmp_path / "t/txn_failed")).count() == 30
    seen = []
    watch(spark, str(out), schema(), lambda r, n: seen.append(r.totals().first().ok_segments), str(tmp_path / "c"), lambda p: F.lit(1), once=True).awaitTermination(120)
    assert sum(seen) == 33


def test_error_text():
    assert render("semantic_error", "no", "invalid_iban", "a.xml", 3) == "[semantic_error:invalid_iban] no (file: a.xml, line: 3)"


# ---- documents by their markup


def test_markup_is_parsed_once(spark, monkeypatch):
    seen, places = [], Cutter.places
    monkeypatch.setattr(Cutter, "places", lambda self, content, is_text: (seen.append(1), places(self, content, is_text))[1])
    cutter = Cutter(*compile_schema(schema()))
    shapes = Shapes(cutter)
    texts = [doc(HEAD.format(n=k), *[TXN.format(id=f"{k}-{j}", amount=j) for j in range(k % 5)]) for k in range(60)]
    texts += [t.replace("</Document>", "</B>") for t in texts[:9]] + [texts[1].replace("0-0", "a&amp;b"), texts[3].replace("<PmtId>", "<!-- > --><PmtId>")]
    for t in texts[:69]:
        parts, fault = shapes.of(t.encode(), False)
        assert sum(p.n for _, _, p in parts) == 1 + t.count("<PmtId>") and (fault is None) == ("</B>" not in t)
    assert len(seen) < 20
    got = [(r.doc_ndx, *r[1:5], r.fault and r.fault.code, *r[6:]) for r in cut(docs_of(spark, texts).repartition(1), schema()).collect()]
    want = [(k, *seg[:4], seg[4] and seg[4]["code"], *seg[5:]) for k, t in enumerate(texts) for seg in cutter.cut(t.encode())]
    assert sorted(got, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    assert {(r.raw, r.tag) for r in cut(docs_of(spark, texts[:3]), schema(), raw=False).collect()} == {(None, None)}


def test_slots_of_other_kinds_are_other_markup(spark):
    s = Schema({"": "u"}, (Segment("t", "r/t", (Field("a", "t/a"), Field("at", "t/a/@q"))),))
    shapes, cutter = Shapes(Cutter(*compile_schema(s))), Cutter(*compile_schema(s))
    for text in ("<r xmlns='u'><t><a q='''>'<b/></a></t></r>", "<r xmlns='u'><t><a q='\"'>x<b/></a></t></r>", "<r xmlns='v'><t><a q='1'>x<b/></a></t></r>", "<r xmlns='u'><t><a q='x>y'>x<b/>z</a></t></r>"):
        known = shapes.of(text.encode(), False)
        assert known and sum(p.n for _, _, p in known[0]) == len([x for x in cutter.cut(text.encode()) if x[0] >= 0])


def test_lines_are_those_of_the_sql(spark):
    src = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("lineitem", "orders")}
    want = spark.sql(queries.lines_sql(queries.SPARK_BIG).replace("FROM lineitem JOIN orders", "FROM {lineitem} JOIN {orders}"), **src)
    got = queries.lines(spark, "/root/testdata/sf0.001")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and "decimal(38" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_cut_together(spark):
    top, kinds = compile_schema(schema())
    cutter, columns = Cutter(top, kinds), Columns(top, kinds)
    plain = [doc(HEAD.format(n=k), *[TXN.format(id=f"{k}é", amount=j) for j in range(k % 5)]) for k in range(40)]
    plain += [t.replace("</Document>", "</B>") for t in plain[:5]] + [plain[4].replace("</PmtId>", "</Pm>", 2), plain[3].replace("<TxId>3é</TxId>", "<TxId/>"), plain[3].replace(NS, "urn:other"), '<?xml version="1.0"?>\n' + plain[2], f"<CdtTrfTxInf xmlns='{NS}'/>", plain[2] + " \n"]
    plain.append(doc(HEAD.format(n=1), TXN.format(id="a > b ' \" ", amount=1), TXN.format(id="", amount=2)))
    ids = "".join(f"<InstgAgt><FinInstnId><BICFI>{k}</BICFI></FinInstnId></InstgAgt>" for k in range(12))
    plain.append(doc(TXN.replace("<CdtrAcct>", ids + "<CdtrAcct>").format(id=1, amount=1) + TXN.format(id=2, amount=2).replace("<PmtId>", "<PmtId><TxId>first</TxId>")))
    t = plain[3]
    odd = ["", " ", "x", t + "x", "x" + t, t + t, t.replace("3é", "&lt;"), t.replace("3é", "<!-- -->"), t.replace("3é", "]]>"), t.replace("3é", "\x01"), t.replace("3é", "a\rb"), t.replace("3é", "<i>1</i>"), t.replace("x:GrpHdr", "q:GrpHdr"), t.replace("</Document>", ""), t.replace("<PmtId>", "<PmtId xmlns='v'>"), t.replace("<PmtId>", "<PmtId a='1' a='1'>"), t.replace("<PmtId>", "<PmtId a='<'>"), t.replace("<PmtId>", "<PmtId a='>'>"), t.replace("<PmtId>", "<PmtId a=1>"), "\n" + '<?xml version="1.0"?>' + t, t.replace("3é", "\uffff"), t[:-1], "<" + t, t.replace("</PmtId>", "</PmtId >")]
    texts = [x for pair in zip(plain, odd + [None] * len(plain)) for x in pair]
    column = pa.array([x.encode() for x in plain], pa.binary())
    known, _, faults = columns.cut(column, lambda d: fault_at(column[int(d)].as_py()), True)
    assert known.all() and len(faults) == 6
    docs = docs_of(spark, texts).coalesce(1)
    for raw in (True, False):
        got = [(r.doc_ndx, *r[1:5], r.fault and r.fault.asDict(), *r[6:]) for r in cut(docs, schema(), raw=raw).collect()]
        want = [(k, *seg) for k, x in enumerate(texts) for seg in cutter.cut(None if x is None else x.encode())]
        want = want if raw else [(*r[:3], None, *r[4:7], None) for r in want]
        assert sorted(got, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_lines_are_shuffled_as_values(spark):
    plan = queries.documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    lists = [x for x in plan.split("collect_list(")[1:]]
    assert lists and not any("CdtTrfTxInf" in x.split(", 0, 0)")[0] or "xml" in x[:40] for x in lists)


def test_no_cast_of_an_empty_text(spark):
    df = spark.createDataFrame([("SI56010000000100090",), ("DE89370400440532013000",), ("MT84MALT011000012345MTLCAST001S",), ("RU0304452522540817810538091310419",)], "v string")
    plan = df.select(validators.iban(F.col("v")).alias("ok"))
    assert [r.ok for r in plan.collect()] == [True, True, True, True]
    for k in (19, 20, 33):  # a cast that fails is an exception, caught row by row
        assert spark.range(1).select(validators._mod97_of_digits(F.lit("SI56010000000100090".ljust(k, "0"))).alias("n")).first().n is not None
    text = plan._jdf.queryExecution().analyzed().toString()
    assert "cast(concat(0, substring(v" in text and "cast(substring(v#" not in text.replace("cast(substring(substr", "")


def test_known_markup_is_followed(spark, monkeypatch):
    """Documents of known markup are neither split at their slots nor cut in arrays, whatever the values."""
    split, arrays, places = [], [], Columns.cut
    monkeypatch.setattr(Columns, "cut", lambda self, *a: (arrays.append(1), places(self, *a))[1])
    s = pacs8()
    shapes, cutter = Shapes(Cutter(*compile_schema(s))), Cutter(*compile_schema(s))
    before = shapes.split
    shapes.split = lambda *a: (split.append(1), before(*a))[1]
    agents = lambda n: "".join(f"<InstgAgt><FinInstnId><BICFI>A{k}</BICFI></FinInstnId></InstgAgt>" for k in range(n))
    txn = TXN.replace("<CdtrAcct>", "{agents}<CdtrAcct>").replace("'EUR'", "'{ccy}'")
    one = lambda k, j: txn.format(id=f"{k}-{j}", amount=j, agents=agents(3 * j), ccy="EUR" if k % 7 else "A\tB")
    texts = ['<?xml version="1.0"?>\n' * (k % 2) + doc(HEAD.format(n=k), *[one(k, j) for j in range(k % 5)]).replace("</Document>", "</Document>" if k % 6 else "</B>") for k in range(300)]
    odd = [texts[3].replace("3-1", x) for x in ("a&lt;b", "&bad;", "]]>", "", "x > y", "é", "\x01", "<b/>", "a\rb", "￿", "<!-- -->")] + [texts[3].replace("'EUR'", "'a<b'", 1), texts[3] + "x", texts[3] + " ", texts[3][:-9], "", None]
    for t in texts:
        assert shapes.quick(t.encode(), True)
    assert len(split) < 30 and any(t.folded for t in shapes.learned)
    all_ = texts + [x for pair in zip(odd, texts) for x in pair]
    for raw in (True, False):
        got = [(r.doc_ndx, *r[1:5], r.fault and r.fault.asDict(), *r[6:]) for r in cut(docs_of(spark, all_).coalesce(1), s, raw=raw).collect()]
        want = [(k, *seg) for k, x in enumerate(all_) for seg in cutter.cut(None if x is None else x.encode())]
        want = want if raw else [(*r[:3], None, *r[4:7], None) for r in want]
        assert sorted(got, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_lines_in_any_order_are_found_at_once():
    """The template of a part is known by its number of tags, not found by trying one after another."""
    agents = lambda n: "".join(f"<InstgAgt><FinInstnId><BICFI>A{k}</BICFI></FinInstnId></InstgAgt>" for k in range(n))
    txn = lambda k, j: TXN.replace("<CdtrAcct>", agents(j) + "<CdtrAcct>").format(id=k, amount=j)
    texts = [doc(HEAD.format(n=k), *[txn(k, (k * 7 + j * j) % 9) for j in range(4)]).encode() for k in range(200)]
    shapes, tried = Shapes(Cutter(*compile_schema(pacs8()))), []
    assert all(shapes.quick(t, True) for t in texts[:100])
    before = cut_module._Template.take
    try:
        cut_module._Template.take = lambda self, *a: (tried.append(1), before(self, *a))[1]
        assert all(shapes.quick(t, True)[0] for t in texts[100:])
    finally:
        cut_module._Template.take = before
    assert len(tried) <= 100 * 8


def test_flat_columns_are_the_values(spark):
    s = pacs8()
    docs = docs_of(spark, [doc(HEAD.format(n=k), *[TXN.format(id=f"{k}-{j}", amount=j) for j in range(k % 4)]) for k in range(30)] + ["<x", None])
    for raw in (True, False):
        nested, flat = cut(docs, s, raw=raw), cut(docs, s, raw=raw, flat=True)
        for kind in ("header", "txn"):
            assert sorted(map(repr, extract(flat, s, kind).collect())) == sorted(map(repr, extract(nested, s, kind).collect()))
        assert flat.where("seg_id < 0").count() == nested.where("seg_id < 0").count() == 2
    one = s.only(txn=("txn_id", "currency"))
    got = extract(cut(docs, one, flat=True), one, "txn").select("doc_ndx", "txn_id", "currency")
    assert sorted(got.collect()) == sorted(extract(cut(docs, s), s, "txn").select("doc_ndx", "txn_id", "currency").collect())


def test_rules_are_worked_out_once(spark, tmp_path):
    calls = tmp_path / "calls"

    def rule(amount):
        with open(calls, "a") as f:
            f.write("x")
        return amount.value is not None  # not for rows of other kinds

    one = doc(HEAD.format(n=2), TXN.format(id="a", amount="2.00"), TXN.format(id="b", amount="900000"))
    bad = one.replace("</Document>", "</B>")
    declared = F.max("header__no_of_txn").alias("declared")
    more = {"doc_rule": F.col("declared") == 2, "doc_aggs": (declared, F.count("*").alias("n"))}
    r = run_import(docs_of(spark, [one, bad, "", "<r/>"]), schema(txn=lambda: F.udf(rule, "boolean")("amount")), **more)
    assert sorted((x.doc_ndx, x.txn_id, x.status) for x in r.segments["txn"].collect()) == [(0, "a", "ok"), (0, "b", "failed"), (1, "a", "skipped"), (1, "b", "skipped")]
    assert calls.read_text() == "xxxx"
    columns = schema(txn=lambda: F.col("amount.value").isNotNull())
    every = [run_import(docs_of(spark, [one, bad, "", "<r/>"]), columns, segments=k, **more).documents for k in (True, False)]
    rows = sorted(map(repr, r.documents.collect()))
    assert len(rows) == 4 and all(sorted(map(repr, d.collect())) == rows for d in every)


def test_rules_look_once(spark):
    accounts = [("SI56010000000100090", True), ("SI56010000000100091", False), ("SI5601000000010009", False), ("DE89370400440532013000", True), ("GB82WEST12345698765432", True), ("XX56010000000100090", False), ("MT84MALT011000012345MTLCAST001S", True), ("", False)]
    d = spark.createDataFrame([(*a, m, w) for a, (m, w) in zip(accounts, [("1.5", "1.50000"), ("1.123456", "1.12345"), (".5", "0.50000"), ("9999999999999.99999", "9999999999999.99999"), ("99999999999999", "0.00000"), ("1.", "1.00000"), ("12a", "12.00000"), ("-1", "0.00000")])], "v string, want boolean, a string, amount string")
    got = d.select("v", "want", "a", "amount", validators.iban(F.col("v")).alias("got"), casts.amount(F.col("a")).cast("string").alias("n"))
    assert all(x.got == x.want and x.n == x.amount for x in got.collect())
    assert "element_at" not in got._jdf.queryExecution().optimizedPlan().toString()  # of 75 countries one by one


def test_attributes_in_one_pass(spark):
    got = queries.extract_attr(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()  # the cut itself, not a table that it was stored in
    rows = got.collect()
    assert rows and all(x.currency == "EUR" and x.header_currency == ("USD" if x.doc % 19 == 0 else "EUR") for x in rows)
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_raw_texts_along_templates():
    cutter = Cutter(*compile_schema(schema()))
    shapes, known, want = Shapes(cutter), cut_module._Known(True), []
    for n in range(120):
        text = doc(HEAD.format(n=n), *[TXN.format(id=f"t{n}é{k}", amount=f"{n}.5") for k in range(1 + n % 3)], sep="" if n % 2 else "\n")
        text = text.replace("</Document>", "</B>") if n % 5 == 0 else text
        found = shapes.quick(text.encode(), False)
        if found and found[0] is not None and known.able(found[0]):
            known.document(n, found[0], shapes.text, shapes.ends)
            want += [(n, seg_id, raw, tag) for seg_id, _, raw, _, fault, _, tag in cutter.cut(text.encode()) if not fault]
    rows = known.rows()
    assert len(want) > 150 and list(zip(rows[0].tolist(), rows[1].tolist(), rows[7].to_pylist(), rows[8].to_pylist())) == want

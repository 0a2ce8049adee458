"""Readers and parsers against small files and texts."""

import datetime
import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.sources import books, disclosures, licences, snapshots


def test_snapshots_of_every_envelope(spark, tmp_path):
    item = {"name": "a", "n": 1, "phone": "010"}
    shapes = {
        2019: {"items": [item, {"name": "b", "n": 2}]},
        2020: {"response": {"header": {}, "body": {"items": {"item": [item]}}}},
        2021: {"response": {"body": {"items": {"item": item}}}},
        2022: {"items": {"item": [item]}},
        2023: {"items": []},
        2024: {"response": {"body": {"items": [item]}}},
    }
    for year, body in shapes.items():
        data = json.dumps(body)
        if year == 2020:
            with gzip.open(tmp_path / f"svc_{year}.json.gz", "wt") as f:
                f.write(data)
        else:
            (tmp_path / f"svc_{year}.json").write_text(data)
    got = snapshots.snapshots(spark, str(tmp_path), "name string, n int, phone string", F.col("n") < 5, ("phone",))
    assert got.columns == ["name", "n", "_yr"]
    assert sorted(map(tuple, got.collect())) == [("a", 1, 2019), ("a", 1, 2020), ("a", 1, 2021), ("a", 1, 2022), ("a", 1, 2024), ("b", 2, 2019)]


def test_cleaned_and_probes(spark):
    df = spark.createDataFrame([("", float("nan")), (" x ", 1.0)], "s string, v double")
    assert sorted(map(tuple, snapshots.cleaned(df).collect()), key=str) == [("x", 1.0), (None, None)]
    probe = lambda rows: snapshots.distinct_contents(spark.createDataFrame(rows, "value string")).first().ok
    assert probe([("a",), ("b",)]) and not probe([("a",), ("a",)]) and not probe([("a",)])


def test_spreadsheet_csv_has_a_mark(spark, tmp_path):
    snapshots.to_spreadsheet_csv(spark.createDataFrame([(1, "가")], "a int, b string").coalesce(1), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfa,b")


@pytest.mark.parametrize("encoding", ["utf-8-sig", "cp949"])
def test_licences(spark, tmp_path, encoding):
    rows = ["개방자치단체코드,관리번호,사업장명,영업상태코드,인허가일자,폐업일자,데이터갱신일자", "1,A,가게,01,20200102,20210101,2024-01-01 00:00:00", "1,A,가게,03,2020-01-02,2024.02.03,2024-03-01 10:00:00", "1,,노키,01,bad,,", "1,,노키,01,bad,,"]
    (tmp_path / "general_food.csv").write_bytes("\n".join(rows).encode(encoding))
    got = licences.licences(spark, str(tmp_path), {"general": "restaurant"}, "CP949" if encoding == "cp949" else "UTF-8").collect()
    assert len(got) == 3 and {r.service for r in got} == {"restaurant"}
    a = next(r for r in got if r.mng_no == "A")
    assert (a.status_code, a.opened_on, a.closed_on) == ("03", datetime.date(2020, 1, 2), datetime.date(2024, 2, 3))
    assert all(r.opened_on is None for r in got if r.mng_no is None)


def test_book_of_a_bank(spark, tmp_path):
    text = "2026 여신 현황\n\n브랜드명;여신잔액(억원);담보구분;회수율\n가;45;보증서;\n나;22.5;부동산담보;70\n나;7.5;;\n다;;신용;\n합계;75;;\n"
    (tmp_path / "book.csv").write_bytes(text.encode("cp949"))
    got = {(r.brand_input, r.exposure_mkrw): r for r in books.read_book(spark, str(tmp_path / "book.csv"), "CP949").collect()}
    assert set(got) == {("가", 4500.0), ("나", 2250.0), ("나", 750.0)}
    assert [got[k].lgd for k in sorted(got)] == [0.1, 0.45, 0.3] and [got[k].collateral for k in sorted(got)] == ["보증서", "미기재", "담보"]
    roll = {r.brand_input: r for r in books.brand_rollup(books.read_book(spark, str(tmp_path / "book.csv"), "CP949")).collect()}
    assert roll["나"].lgd == pytest.approx(0.3375) and roll["나"].mix == "담보 75% · 미기재 25%"
    with pytest.raises(ValueError):
        (tmp_path / "none.csv").write_text("a,b\n1,2\n")
        books.read_book(spark, str(tmp_path / "none.csv"))


def test_delimiters_and_units(spark):
    assert [books.delimiter([x] * 3) for x in ("a,b", "a\tb\tc", "a;b", "a|b", "a")] == [",", "\t", ";", "|", ","]
    unit = lambda v: books.unit_of_values(spark.createDataFrame([("a", x, None) for x in v], "brand_input string, exposure_raw double, n_borrowers double"))
    assert (unit([4.5e9]), unit([4500.0]), unit([45.5])) == (1e-6, 1.0, 100.0)


def test_collateral_by_the_order_of_the_rules(spark):
    phrases = {"보증서": "보증서", "신용보증재단 보증서": "보증서", "보증서담보대출": "보증서", "임차보증금": "담보", "전세": "담보", "부동산담보": "담보", "근저당": "담보", "예적금": "담보", "신용": "신용", "무담보": "신용", "무보증": "신용", "unsecured": "신용", "": "미기재", None: "미기재", "-": "미기재", "기계": "기타"}
    got = spark.createDataFrame([(k,) for k in phrases], "s string").select("s", expr.collateral(F.col("s")).alias("k")).collect()
    assert {r.s: r.k for r in got} == phrases


def test_amounts_names_and_dates(spark):
    one = lambda e, v: spark.createDataFrame([(v,)], "s string").select(e(F.col("s"))).first()[0]
    for raw, value in {"1,234": 1234.0, "(500)": -500.0, "△30": -30.0, "▲1.5": -1.5, "−7": -7.0, "₩ 9,000원": 9000.0, "80%": 80.0, "A동 102호": None, "3층-2": None, "": None, "-": None}.items():
        assert one(expr.money, raw) == value
    assert one(expr.corporate_name, "(주)앤하우스") == one(expr.corporate_name, "앤하우스 주식회사") == "앤하우스"
    assert one(expr.aliases, "피자나라 치킨공주(피나치공)") == ["피나치공", "피자나라치킨공주", "피자나라치킨공주피나치공"]
    assert one(lambda c: expr.particle(c, "은", "는"), "본점") == "본점은" and one(lambda c: expr.particle(c, "은", "는"), "가게") == "가게는"
    assert one(expr.origination_year, "1995") is None and one(expr.origination_year, "45047") == 2023
    assert str(one(expr.mail_date, "Mon, 30 Sep 2024 23:00:00 +0000")) == "2024-10-01" and one(expr.mail_date, "yesterday") is None
    assert one(expr.nfkc, "ＡＢ㈜") == "AB(주)"


def test_units_totals_and_loss_rates(spark):
    factors = {"여신잔액(억원)": 100.0, "금액 (백만원)": 1.0, "잔액(천원)": 0.001, "여신잔액(만원)": 0.01, "잔액(원)": 1e-6, "MKRW": 1.0, "Balance in million": 1.0, "KRW": 1e-6, "won": 1e-6, "브랜드": None, "천안": None, None: None}
    got = spark.createDataFrame([(k,) for k in factors], "s string").select("s", expr.unit_factor(F.col("s")).alias("f")).collect()
    assert {r.s: r.f for r in got} == factors
    names = {"합 계": True, "총계(2024)": True, "소계 - 서울": True, "계": True, "합": True, "전체": True, "Sub Total": True, "SUM": True, "Grand-Total": True, "계란나라": False, "합정치킨": False, "summer": False}
    got = spark.createDataFrame([(k,) for k in names], "s string").select("s", books.is_total(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in got} == names
    assert books.LGD["담보"] == 0.25


def test_unit_of_a_book(spark):
    rows = lambda *v, b=None: spark.createDataFrame([(f"b{i}", float(x), b and float(b)) for i, x in enumerate(v)], "brand_input string, exposure_raw double, n_borrowers double")
    assert [books.unit_of_values(r) for r in (rows(4.5e9), rows(4500), rows(45.5, 12.5), rows(45), rows(300, b=200), rows(120, b=120), rows(500))] == [1e-6, 1.0, 100.0, 100.0, 100.0, 100.0, 1.0]
    loans = spark.createDataFrame([("a", 20.0, None), ("a", 30.0, None), ("b", 25.0, None)], "brand_input string, exposure_raw double, n_borrowers double")
    assert books.unit_of_values(loans) == 1.0


def test_tables_by_header_name(spark):
    page = "<h3>재무</h3><p>x</p><table><tr><th>연도</th><th>자산 </th><th>매출</th></tr><tr><td>2023</td><td>1,200</td><td>△<b>30</b></td></tr><tr><td>2022</td><td>0</td><td>-</td></tr><tr><td>only</td></tr></table>"
    df = spark.createDataFrame([(page,), ("<h3>none</h3>",), (None,)], "p string")
    rows = df.select(disclosures.records(disclosures.table_after(F.col("p"), "재무")).alias("r")).collect()
    assert [r.r for r in rows] == [[{"연도": "2023", "자산": "1,200", "매출": "△ 30"}], [], []]
    got = df.limit(1).select(F.transform(disclosures.records(disclosures.table_after(F.col("p"), "재무")), lambda m: disclosures.amounts(m, 1000)).alias("r")).first().r
    assert got == [{"연도": 2023000.0, "자산": 1200000.0, "매출": -30000.0}]


def test_sections_years_and_flags(spark):
    text = "앞\nI. 첫째\n본문 가\nII. 둘째\n해당사항 없음\nI. 다시\n나\n"
    df = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "id int, t string")
    assert sorted((r.id, r.code, r.body) for r in disclosures.sections(df, "id", "t").collect()) == [(1, "I", "첫째\n본문 가"), (1, "II", "둘째\n해당사항 없음")]
    flag = lambda s: spark.createDataFrame([(s,)], "s string").select(disclosures.risk_flag(F.col("s"))).first()[0]
    assert (flag("해당 사항 없음"), flag("가" * 500), flag("가"), flag(None)) == (0, 1, None, None)
    y = spark.createDataFrame([("2021 1,000 (20)\nx\n2022 - 5\n2023 1\n",)], "s string").select(disclosures.year_rows(F.col("s"), ["a", "b"], 10)).first()[0]
    assert [tuple(r) for r in y] == [(2021, 10000.0, -200.0), (2022, None, 50.0)]


def test_statements_and_opinions(spark):
    amount = lambda s: spark.createDataFrame([(s,)], "s string").select(disclosures.statement_amount(F.col("s"), ["매출액", "영업수익"])).first()[0]
    assert amount("I. 매출액 (주1) 1,234,567 900") == 1234567.0 and amount("영업수익 (1,000)") == -1000.0 and amount("없다") is None
    # years, notes and amounts of the text before the table are none
    assert amount("매출액 2018년 1,234,567") == 1234567.0 and amount("매출액 (주14,17) 1,234,567") == 1234567.0 and amount("매출액 2018") is None and amount("매출액 - 5,000") == 0.0
    assert amount("매 출 액 1,234,567") == 1234567.0 and amount("매출액 ( 1,500 )") == -1500.0 and amount("매출액 1,23 4567") is None and amount("매출액 (1,5") is None
    both = spark.createDataFrame([("목차 손익계산서 10 매출액 1,419 백만원 " + "주석 " * 200 + "손 익 계 산 서 (단위: 원) 매출액 77,000",), ("영업손실 1,500",), ("영업손실 (1,500)",), ("영업이익 2,500",)], "s string")
    assert both.select(disclosures.statement_amount(F.col("s"), ["매출액"], results=True)).first()[0] == 77000.0
    assert [r[0] for r in both.select(disclosures.statement_amount(F.col("s"), [("영업이익", 1), ("영업손실", -1)])).collect()][1:] == [-1500.0, -1500.0, 2500.0]
    o = spark.createDataFrame([("감사의견: 적정의견",), ("의견거절",), ("an unqualified opinion",), ("",)], "s string").select(disclosures.audit_opinion(F.col("s"))).collect()
    assert [r[0] for r in o] == ["unqualified", "disclaimer", "unqualified", None]
    g = spark.createDataFrame([("계속기업으로서의 존속능력에 불확실성",), ("x" * 500,), ("x",)], "s string").select(disclosures.going_concern(F.col("s"))).collect()
    assert [r[0] for r in g] == [1, 0, None]
    b = spark.createDataFrame([(100.0, 50.0, 50.0, 10.0, 5.0, 1.0), (100.0, 10.0, 50.0, -1.0, 5.0, 1.0), (None, 1.0, 1.0, 10.0, 50.0, 1.0)], "assets double, liabilities double, equity double, revenue double, operating_income double, net_income double")
    assert [tuple(r) for r in disclosures.balance_gate(b).collect()] == [(100.0, 50.0, 50.0, 10.0, 5.0, 1.0), (None,) * 6, (None, 1.0, 1.0, None, None, None)]


def test_audit_reports_by_spans(spark):
    read = lambda t: spark.createDataFrame([(t,)], "t string").select(disclosures.audit_reading(F.col("t")).alias("r"), disclosures.going_concern_reading(F.col("t")).alias("g")).first()
    fair, title = "우리의 의견으로는 재무제표는 공정하게 표시하고 있습니다. ", "외부 감사인의 감사보고서 주식회사 가 이사회 귀중 "
    assert read(None).r is None and read(None).g is None and read("").r is None and read("").g == 0
    # another report's or an earlier year's opinion, in the past tense or mid-sentence, is none
    assert tuple(read(title + "감사의견 우리는 감사했습니다. " + fair + "기타사항 전기에는 의견을 표명하지 않았습니다.").r) == ("unqualified", "heading")
    assert tuple(read(title + fair + "내부회계관리제도 검토보고서 재무제표에 대하여 의견을 표명하지 않습니다.").r) == ("unqualified", "sentence")
    assert tuple(read(title + "한정 의견: 우리는 감사했습니다. " + fair).r) == ("qualified", "heading")
    assert tuple(read("한정의견이 표명되었습니다. " + fair).r) == ("unqualified", "sentence")
    # doubt counts in the basis of a modified opinion, not in what is said of everybody's duties
    assert read(title + "한정의견근거 계속기업 가정에 의문이 있습니다. 감사인의 책임 없음").g == 1
    assert read(title + "한정의견근거 재고 실사를 못했습니다. 감사인의 책임 계속기업의 불확실성을 평가합니다").g == 0
    assert read(title + "한정의견근거 단락에 적은 대로 계속기업 불확실").g == 0

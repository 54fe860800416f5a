"""Texts derived from the given tables, for queries that need Japanese contracts.

Each text is one SQL expression that Spark and any ANSI engine read alike, so a
query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kuronuri.sources.texts import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(table(spark, sf_dir, name))


def _pad(expr: str, n: int) -> str:
    return f"lpad(cast({expr} as string), {n}, '0')"


# k is the customer key, s_name its supplier, c_name the customer.
CONTRACT_TEXT = f"""concat(
 '株式会社', s_name, ' （以下「甲」という）と', chr(10),
 '株式会社', c_name, ' （以下「乙」という）は', chr(10),
 '契約日 ', 2000 + k % 25, '年', 1 + k % 12, '月', 1 + k % 28, '日', chr(10),
 '連絡先 user', k, '@example.com', chr(10),
 '電話 03-', {_pad('k % 10000', 4)}, '-', {_pad('(k * 7) % 10000', 4)}, chr(10),
 '〒', 100 + k % 900, '-', {_pad('k % 10000', 4)}, ' 所在地', chr(10),
 case k % 4 when 0 then '東京都千代田区丸の内1-' when 1 then '神奈川県横浜市西区1-'
            when 2 then '北海道函館市若松町' else '大阪府大阪市北区2-' end, k, chr(10),
 '契約番号 AB', {_pad('k % 10000', 4)}, ' 管理番号 PRIV-2025-Q3-', {_pad('k % 1000', 3)}, chr(10),
 '氏名', chr(10), '鈴木 一郎', chr(10), 10 + k % 90, chr(10),
 case k % 2 when 0 then '男' else '女' end, chr(10),
 '　佐藤　花子', chr(10), '佐藤 花子', chr(10),
 '担当：田中 (担当:山本) （担当:高橋） 年齢：', 20 + k % 70, chr(10),
 '金額 ¥', 10 + k % 90, ',000 と ', 1 + k % 9, '万円', chr(10),
 '令和', 1 + k % 6, '年 平成元年', chr(10),
 '（株）', c_name, ' 御中', chr(10),
 '契約当事者 甲 と 乙 は ', c_name, '株式会社 と', chr(10),
 '合同会社', c_name, ' 本契約 を <締結> & "確認"', chr(10))"""

# kind -> text; k is the supplier key, nm the supplier name.
SNIPPETS: dict[str, str] = {
    "email": "concat('連絡先 user', k, '@example.com', chr(10))",
    "phone": f"concat('電話 03-1234-', {_pad('k % 10000', 4)}, chr(10))",
    "postal": f"concat('〒100-', {_pad('k % 10000', 4)}, ' ', chr(10))",
    "compact_id": f"concat('契約番号 AB', {_pad('k % 10000', 4)}, chr(10))",
    "hyphen_id": f"concat('管理番号 PRIV-2025-Q3-', {_pad('k % 1000', 3)}, chr(10))",
    "name_line": "concat('氏名', chr(10), '鈴木 一郎', chr(10))",
    "contact": "concat('担当：田中', chr(10))",
    "contact_paren": "concat('(担当:田中)', chr(10))",
    "contact_fwparen": "concat('（担当:田中）', chr(10))",
    "age_colon": "concat('年齢：', 10 + k % 90, chr(10))",
    "age_line": "concat('鈴木 一郎', chr(10), 10 + k % 90, chr(10), '男', chr(10))",
    "money_yen": "concat('金額 ¥', 10 + k % 90, ',000 ', chr(10))",
    "money_unit": "concat('金額 ', 10 + k % 90, '万円', chr(10))",
    "ymd": "concat('契約日 2024年3月1日', chr(10))",
    "wareki": "concat('令和6年', chr(10))",
    "address": "concat('東京都千代田区丸の内1-', k, chr(10))",
    "address_stem3": "concat('神奈川県横浜市西区1-', k, chr(10))",
    "company_prefix": "concat('株式会社', nm, ' 御中', chr(10))",
    "company_suffix": "concat(nm, '株式会社', chr(10))",
    "company_abbr": "concat('（株）', nm, ' 御中', chr(10))",
    "parties": "concat('契約当事者 甲 は', chr(10))",
}

# Party definitions in every form; k is the customer key, s_name its supplier.
PARTY_TEXT = """concat(
 case k % 6
  when 0 then concat('売主・', s_name, ' （以下「売主」という。）と、買主・', c_name, 'は （以下「買主」という。）、')
  when 1 then concat('委託者、', s_name, '（以下『委託者』という）と及び・', c_name, 'とは（以下「乙」という）')
  when 2 then concat('「甲」（', s_name, 'は）と「発注者」(と', c_name, ')')
  when 3 then concat('以下「本契約」という。以下「貸主」という。以下「甲」という。以下「別紙」という。')
  when 4 then concat(s_name, '（以下「受託者」という）、', c_name, '（以下「甲」という）、', c_name, '（以下「甲」という）')
  else concat('甲', s_name, '（以下「甲」という）', chr(10), '乙：', c_name, 'に（以下 ｢乙｣ という）', chr(10), 'A（以下「丙」という）')
 end, chr(10), '以下「本件」という。')"""


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with one supplier: ``(k, c_name, s_name)``."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    count = supplier.agg(F.count("*").alias("n")).scalar()
    customer = texts(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), "c_name", (F.col("c_custkey") % count).alias("s_suppkey")
    )
    return customer.join(supplier, "s_suppkey").select("k", "c_name", "s_name")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select(
        F.expr("concat('c', k)").alias("doc_id"), F.expr(CONTRACT_TEXT).alias("text")
    )


def party_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select(
        F.expr("concat('y', k)").alias("doc_id"), F.expr(PARTY_TEXT).alias("text")
    )


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.expr(text).alias("text"))
            for kind, text in SNIPPETS.items()
        ]
    )
    return (
        table(spark, sf_dir, "supplier")
        .select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("nm"))
        .select("k", F.explode(kinds).alias("x"))
        .select(F.concat(F.lit("s_"), "x.kind", F.lit("_"), "k").alias("doc_id"), "x.text")
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents").select(
        F.expr("concat('d', doc_id)").alias("doc_id"), "text"
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "pages").select(
        F.expr("concat('p', page_id)").alias("doc_id"), F.col("html").alias("text")
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents and pages, contracts and snippets."""
    return (
        documents(spark, sf_dir).unionByName(pages(spark, sf_dir))
        .unionByName(contracts(spark, sf_dir)).unionByName(snippets(spark, sf_dir))
    )


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and contracts."""
    return documents(spark, sf_dir).unionByName(contracts(spark, sf_dir))


# --- the same rows in SQL ---------------------------------------------------------------

CUSTOMERS_SQL = (
    "select c_custkey as k, c_name, s_name from customer join supplier "
    "on s_suppkey = c_custkey % (select count(*) from supplier)"
)
CONTRACTS_SQL = f"select concat('c', k) as doc_id, {CONTRACT_TEXT} as text from ({CUSTOMERS_SQL})"
PARTY_TEXTS_SQL = f"select concat('y', k) as doc_id, {PARTY_TEXT} as text from ({CUSTOMERS_SQL})"
SNIPPETS_SQL = " union all ".join(
    f"select concat('s_{kind}_', k) as doc_id, {text} as text "
    "from (select s_suppkey as k, s_name as nm from supplier)"
    for kind, text in SNIPPETS.items()
)
DOCUMENTS_SQL = "select concat('d', doc_id) as doc_id, text from documents"
PAGES_SQL = "select concat('p', page_id) as doc_id, html as text from pages"
CORPUS_SQL = " union all ".join((DOCUMENTS_SQL, PAGES_SQL, CONTRACTS_SQL, SNIPPETS_SQL))
MIXED_SQL = f"{DOCUMENTS_SQL} union all {CONTRACTS_SQL}"

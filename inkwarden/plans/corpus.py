"""Synthetic case files over the orders table: one SQL text that Spark and DuckDB run alike.

An order is a page, its customer the document; every page has one frame of sentences and one of seven odd ones,
with near misses of the rules. Word boxes of recognition passes come from the
conversations table, a turn being a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import partitions, table

CASES = """
SELECT doc_id, page_num,
  'Interview record. Refcom no: ' || lpad(CAST(ok AS STRING), 6, '0') || '. The applicant '
  || split_part('Mohamed,Muhammad,Mohammed,Fatoumata,Yousef,Ahmed,Olexandr,Tesfay', ',', a) || ' '
  || split_part('Al-Hassan,ibn Omar,Warsame,Berhane,Kovalenko', ',', c) || ', a '
  || split_part('Syrian,Somali,Eritrean,Afghan,Ukrainian', ',', c) || ' national born in '
  || split_part('Aleppo,Mogadishu,Asmara,Kabul,Kharkiv', ',', c) || ' on '
  || CASE m WHEN 0 THEN CAST(CAST(d AS INT) AS STRING) || ' ' || mname || ' ' || y
            WHEN 1 THEN d || '/' || mo || '/' || y
            WHEN 2 THEN y || '-' || mo || '-' || d
            ELSE CAST(CAST(d AS INT) AS STRING) || 'th ' || mname || ' ' || y END
  || ', fled from ' || split_part('Syria,Somalia,Eritrea,Afghanistan,Ukraine', ',', c) || ' with his '
  || split_part('wife,mother,two children,brother,sister,cousin', ',', b)
  || ' by route via Tripoli-Malta. Passport No: AB' || ck || '. Contact user' || ck || '@mail' || CAST(b AS STRING)
  || '.example.com or +353 1 555 ' || lpad(CAST(ok % 10000 AS STRING), 4, '0')
  || '. Lives at ' || CAST(b AS STRING) || ' Harbour View Road, placed in Reception Centre Lesvos.'
  || CASE CAST(ok % 7 AS INT)
     WHEN 0 THEN ' Case No: KX' || lpad(CAST(ok % 1000 AS STRING), 4, '0') || ' and File IRL/2019/44; ref. Passport no X12 is short.'
     WHEN 1 THEN ' Not dates: 31/02/2001x, 99/99/9999; born in Lyon on 12 mars 1999, née à Lille Sud.'
     WHEN 2 THEN ' mail@host, @x.org, +12 3, case no 5, ID: ABC1, 12 Long Lane.'
     WHEN 3 THEN ' Supreme Court, Legal Representative Review of Al-Hassan O' || chr(39) || 'Neill; JOHN SMITH, Article Nine. March John Doe (El-Sayed) met van Dyck and Fatima bint al-Ali.'
     WHEN 4 THEN ''
     WHEN 5 THEN ' aged 12, 3 children; 17 years old Malian from Mali via SYRIA, Syrians, Sri Lanka, Sierra Leonean.'
     ELSE ' IPAT reference: 77/b-2 and MTL-2024-12345, Refcom/1234; passport AB12 3456 of Sudan South.' END
  || CASE WHEN page_num = 1 THEN ' ' || rpad('P<SYRALHASSAN<<' || upper(split_part('Mohamed,Muhammad,Mohammed,Fatoumata,Yousef,Ahmed,Olexandr,Tesfay', ',', a)), 44, '<')
       || ' ' || rpad('AB' || ck || '0SYR' || substring(y, 3, 2) || mo || d || '0M3001019', 44, '<') ELSE '' END AS text
FROM (
  SELECT o_custkey AS doc_id, o_orderkey AS ok,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS page_num,
    CAST(o_custkey % 8 AS INT) + 1 AS a, CAST(o_orderkey % 6 AS INT) + 1 AS b, CAST(o_custkey % 5 AS INT) + 1 AS c,
    CAST(o_orderkey % 4 AS INT) AS m,
    CAST(year(o_orderdate) AS STRING) AS y, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS mo, lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS d,
    split_part('January,February,March,April,May,June,July,August,September,October,November,December', ',', CAST(month(o_orderdate) AS INT)) AS mname,
    lpad(CAST(o_custkey AS STRING), 7, '0') AS ck
  FROM {orders}) k
"""

#: Words of turns in four passes, with boxes, confidences, losses and misreadings by whole-number rules.
WORDS = """
SELECT conv_id AS doc_id, turn AS page_num, CAST(q AS INT) AS pass_id, CAST(k AS INT) AS seq,
  CASE WHEN (k * q) % 5 = 1 THEN concat('x', substring(w, 2)) ELSE w END AS text,
  CAST((37 * k + 11 * q + 5 * turn) % 100 AS DOUBLE) AS confidence,
  CAST(60 * (k % 12) + q AS DOUBLE) AS x0, CAST(24 * CAST(floor(k / 12) AS BIGINT) + (q % 2) AS DOUBLE) AS y0,
  CAST(60 * (k % 12) + q + 8 * length(w) AS DOUBLE) AS x1, CAST(24 * CAST(floor(k / 12) AS BIGINT) + (q % 2) + 16 AS DOUBLE) AS y1
FROM ({tokens}) t
WHERE (k + q) % 7 <> 0
"""
_SPARK_TOKENS = r"""SELECT conv_id, turn, CAST(p AS BIGINT) AS k, w, CAST(q AS BIGINT) AS q FROM {conversations}
  LATERAL VIEW posexplode(regexp_extract_all(coalesce(text, ''), r'[^ \t\n\r]+', 0)) e AS p, w LATERAL VIEW explode(array(0, 1, 2, 3)) f AS q"""
_DUCK_TOKENS = r"""SELECT conv_id, turn, CAST(p AS BIGINT) AS k, w, q FROM (SELECT conv_id, turn, unnest(ws) AS w, unnest(generate_series(0, len(ws) - 1)) AS p
  FROM (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+') AS ws FROM conversations) s) t0, (SELECT unnest([0, 1, 2, 3])::BIGINT AS q) t1"""

_PAGE_NUM = "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS page_num"
CASES_SQL = CASES.replace("{orders}", "orders")
WORDS_SQL = WORDS.replace("{tokens}", _DUCK_TOKENS)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``page_num``, ``text``.

    Pages are numbered before columns get their other names, so that Spark knows all pages of a document together;
    the number of partitions is fixed, as few bytes are much work in all that follows.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").repartition(partitions(spark), "o_custkey")
    numbered = spark.sql(f"SELECT *, {_PAGE_NUM} FROM {{orders}}", orders=orders)
    return spark.sql(CASES.replace(_PAGE_NUM, "page_num"), orders=numbered)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``page_num``, ``pass_id``, ``seq``, ``text``, ``confidence``, ``bbox``."""
    rows = spark.sql(WORDS.replace("{tokens}", _SPARK_TOKENS), conversations=table(spark, sf_dir, "conversations"))
    return rows.selectExpr("doc_id", "page_num", "pass_id", "seq", "text", "confidence", "named_struct('x0', x0, 'y0', y0, 'x1', x1, 'y1', y1) AS bbox")

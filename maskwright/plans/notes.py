"""Notes: short texts derived from the orders table that fire every rule.

The SQL runs unchanged in Spark and DuckDB. Ten text shapes cycle on the order
key; one has no findings, one has an emoji, accents and a line break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOTES_SQL = """
WITH b AS (SELECT o_orderkey AS k, o_custkey AS c, cast(cast(o_orderdate AS date) AS string) AS dt,
  split_part('Alice,Brandon,Chloe,Daniel,Evelyn,Farid,Grace,Hassan', ',', cast(o_orderkey % 8 + 1 AS int)) AS fn,
  split_part('Tan,Reed,Chen,Kumar,Neumann,Lim,Ong', ',', cast(o_custkey % 7 + 1 AS int)) AS ln,
  lpad(cast((o_orderkey * 7919 + 1234567) % 10000000 AS string), 7, '0') AS d7,
  lpad(cast((o_custkey * 104729 + 7654321) % 10000000 AS string), 7, '0') AS c7 FROM orders)
SELECT k AS doc_id, CASE cast(k % 10 AS int)
 WHEN 0 THEN concat('Dr. ', fn, ' ', ln, ' and ', fn, ' ', ln, ' called. Her nric is S', d7, 'A, my email is ', lower(fn), '.', cast(k AS string), '@mail.example.com')
 WHEN 1 THEN concat('Payment to ', ln, ' Solutions Pte Ltd with reference no INV-', substr(dt,1,4), '-', d7, '. Check savings account number 123-', substr(d7,1,6), '-0.')
 WHEN 2 THEN concat('Her passport number is E', d7, 'X; contact number 9', d7, ' or (65) 8', substr(c7,1,3), '-', substr(d7,1,4), '.')
 WHEN 3 THEN concat('Deliver to ', cast(c % 900 + 1 AS string), ' Orchard Road, Singapore ', substr(d7,1,6), '. Ask for ', fn, ' van ', ln, '.')
 WHEN 4 THEN concat('Order #A', d7, ' dated ', dt, ', paid from 123-456-', substr(c7,1,4), '-1, cvc of ', substr(c7,1,3))
 WHEN 5 THEN concat('Security Code of ', substr(d7,1,4), ', card 4242 4242 ', substr(d7,1,4), ' ', substr(c7,1,4), '. NRIC: T', c7, 'Z, again nric T', c7, 'Z')
 WHEN 6 THEN concat('nothing to report for item ', cast(k % 97 AS string), ', all fine')
 WHEN 7 THEN concat('😀 Zoé', fn, ' ', ln, 'é met Ms ', fn, ' ', ln, chr(10), 'Mr ', ln, ' Ong on ', dt)
 WHEN 8 THEN concat(ln, ' Holdings Inc, ', fn, ' Realty LLC. Ref: ', substr(c7,1,5), '-', substr(d7,1,3), ' reach ', lower(ln), '@corp-', cast(c AS string), '.example.sg')
 ELSE concat('account no. 99', d7, '12345 mobile number +65 9', substr(d7,1,3), ' ', substr(c7,1,4), ' born ', substr(dt,9,2), '/', substr(dt,6,2), '/', substr(dt,1,4)) END AS text
FROM b
"""


def notes(spark: SparkSession, orders: DataFrame) -> DataFrame:
    """The notes of an orders table (batch or stream)."""
    return spark.sql(NOTES_SQL.replace("FROM orders", "FROM {orders}"), orders=orders)

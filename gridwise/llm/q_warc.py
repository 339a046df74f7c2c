"""Query op3: audit of a replica of all pages in which some records of every third archive were changed and some lost."""

from pyspark.sql import functions as F

from gridwise.llm import warc
from gridwise.llm._common import table


def op3_warc_fixity(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    drawn = F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 97
    fate = F.when(F.pmod(F.shiftright("page_id", 12), F.lit(3)) == 0, drawn).otherwise(-1)
    damaged = pages.filter(fate != 1).withColumn("html", F.when(fate == 0, F.concat("html", F.lit("?"))).otherwise(F.col("html")))
    return warc.audit(warc.leaves(warc.records(pages)), warc.leaves(warc.records(damaged)))


SQL = """WITH r AS (SELECT page_id, page_id // 4096 AS shard, strlen('WARC/1.0') + strlen('WARC-Type: response') + strlen('WARC-Record-ID: <urn:page:' || page_id || '>')
    + strlen('WARC-Target-URI: ' || url) + strlen('Content-Type: text/html') + strlen('Content-Length: ' || strlen(html)) + 14 + strlen(html) + 4 AS length FROM pages),
o AS (SELECT *, sum(length) OVER (PARTITION BY shard ORDER BY page_id) - length AS "offset", CASE WHEN shard % 3 = 0 THEN ('0x' || md5(page_id::VARCHAR)[1:8])::BIGINT % 97 ELSE -1 END AS fate FROM r)
SELECT page_id, CASE fate WHEN 0 THEN 'changed' ELSE 'missing' END AS kind, shard, CAST("offset" AS BIGINT) AS "offset", length FROM o WHERE fate IN (0, 1)"""


def queries():
    return {"op3_warc_fixity": op3_warc_fixity}


def oracle_sql():
    return {"op3_warc_fixity": SQL}

"""The dealt queries: name -> Spark callable, and DuckDB text where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import tune
from . import brown, decontam, fixity, licences, mixing, pages, pii, quality, sharding, simhash, tokalign, urls, variants
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op1_url_templates(spark, sf_dir):
    return urls.judge(urls.labelled_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")))


@query()
def op2_personal_data(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


@query()
def op3_benchmark_decontamination(spark, sf_dir):
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _shard_sql() -> str:
    held = ",".join(map(str, sharding.lookup_table(sharding.shard_names())))
    return f"""
    with held as (select [{held}] as shards),
    slots as (select doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar),
        'text:' || md5(coalesce(text, '')))), 1, 15) as bigint) % {sharding.SLOTS} as slot from documents)
    select doc_id, slot, shards[slot + 1] as shard from slots, held"""


@query(_shard_sql())
def op4_sharding(spark, sf_dir):
    return sharding.place(table(spark, sf_dir, "documents"), ["doc_id"])


@query()
def op5_brown_scoring(spark, sf_dir):
    return brown.score(table(spark, sf_dir, "documents"))


@query()
def op6_quality_rules(spark, sf_dir):
    judged, at = quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc_id", f"{at}.*")


# Archives of 4096 records; the replica's faults follow from a hash of the offset.
_FIXITY_SQL = """
    with records as (select page_id, substr(md5(cast(page_id as varchar)), 1, 2) as fault from pages)
    select cast(floor(page_id / 4096) as bigint) as archive, page_id as "offset",
        case when fault = '02' then 'missing' else 'changed' end as status
    from records where fault in ('00', '01', '02', '03') group by all"""


@query(_FIXITY_SQL)
def op7_merkle_fixity(spark, sf_dir):
    records = fixity.page_records(table(spark, sf_dir, "pages"))
    return fixity.audit(records, fixity.damaged_replica(records))


@query()
def op8_simhash_near_dedup(spark, sf_dir):
    found, at = simhash.near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex(F.col(at)["fp"]), 16, "0")).alias("fingerprint"),
        F.col(at)["component_id"].alias("component_id"),
    )


@query()
def op9_mixing(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


@query()
def op10_page_text(spark, sf_dir):
    texts, at = pages.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return texts.select("page_id", "url", F.col(at).alias("text"), F.length(at).cast("long").alias("n_chars"))


@query()
def op11_licence_scan(spark, sf_dir):
    return licences.report(table(spark, sf_dir, "documents"))


@query()
def op12_token_alignment(spark, sf_dir):
    return tokalign.report(table(spark, sf_dir, "documents"))


@query()
def op13_spelling_variants(spark, sf_dir):
    return variants.report(table(spark, sf_dir, "documents"))

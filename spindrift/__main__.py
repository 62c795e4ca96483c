"""Batch work by spark-submit: `python -m spindrift COMMAND --store FOLDER ...`. Tables in and out are Parquet.

ingest    --in RAW --run NAME [--force]             registers or syncs raw documents
refresh   --in LISTING [--bodies BODIES] --run NAME  brings the metadata, and the sections, to a listing
overflow  --out TABLE [--limit N]                    sections of more words than the limit, by document type
reembed   --run NAME [--dim N]                       embeds chunks that changed
compact, vacuum                                      writes the live rows anew; removes files that no version names
A run that was stopped goes on when it is started again under the same name.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import SearchError, payload
from .operators import chunks
from .plans import ingest
from .sources.store import Store


def hashed(dim: int):
    """The hash embedding as arrays, of (chunk_id, text)."""

    def embed(todo):
        parts = chunks.hash_embedding(todo, "chunk_id", dim=dim).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))
        every = F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long"))
        return parts.select(F.col("key").alias("chunk_id"), F.transform(every, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))

    return embed


def run(spark: SparkSession, arguments: list[str]) -> dict:
    parser = argparse.ArgumentParser(prog="spindrift")
    parser.add_argument("command", choices=["ingest", "refresh", "overflow", "reembed", "compact", "vacuum"])
    parser.add_argument("--store", required=True)
    for name in ("--in", "--out", "--bodies"):
        parser.add_argument(name)
    parser.add_argument("--run", default="")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--limit", type=int, default=chunks.TOKEN_LIMIT)
    parser.add_argument("--dim", type=int, default=256)
    given = vars(parser.parse_args(arguments))
    store, now = Store(spark, given["store"]), datetime.now(timezone.utc).replace(tzinfo=None)
    table = lambda name: spark.read.parquet(given[name]) if given[name] else None
    try:
        match given["command"]:
            case "ingest":
                return ingest.ingest(store, table("in"), given["run"], now, given["force"])
            case "refresh":
                return ingest.refresh(store, table("in"), given["run"], now, table("bodies"))
            case "overflow":
                snapshot = store.snapshot()
                own = snapshot.table("sections").join(snapshot.table("documents").select("document_id", "doc_type"), "document_id")
                rows = chunks.overflow(own.select("doc_type", chunks.section_text().alias("text")), "doc_type", given["limit"])
                rows.write.mode("overwrite").parquet(given["out"])
                return {"types": spark.read.parquet(given["out"]).count()}
            case "reembed":
                return ingest.reembed(store, given["run"], f"hash-{given['dim']}", hashed(given["dim"]))
            case "compact":
                return {"version": store.compact().version}
            case _:
                store.vacuum()
                return {"versions": store.versions()}
    except SearchError as e:
        return payload(e)


def main() -> None:
    done = run(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), sys.argv[1:])
    print(json.dumps(done))
    sys.exit("error" in done)


if __name__ == "__main__":
    main()

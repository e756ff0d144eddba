"""redact INPUT OUTPUT [--offline] [--company-list PATH] [--ignore-verify-failure] [--render NAME] [--plugins FILE]; exit codes 0, 1, 2."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.model import EngineConfig
from .operators.augment import usage_totals
from .operators.verify import batch_summary, with_progress
from .plans.redact import redact_documents
from .sources import extractors, files, sinks


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veilmark", description=__doc__)
    redact = parser.add_subparsers(required=True).add_parser("redact")
    redact.add_argument("input")
    redact.add_argument("output")
    redact.add_argument("--offline", action="store_true", help="no reporter is asked")
    redact.add_argument("--company-list")
    redact.add_argument("--ignore-verify-failure", action="store_true", help="keep documents whose masked texts are still recoverable, and warn")
    redact.add_argument("--render", help="the renderer that Markdown and HTML go through")
    redact.add_argument("--plugins", help="a Python file that registers extractors, painters, renderers and reporters")
    a = parser.parse_args(argv)
    say = lambda text: print(text, file=sys.stderr)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.plugins:
        extractors.load(a.plugins)
    names, warning = files.company_setting(spark, a.company_list, os.environ.get("VEILMARK_COMPANY_LIST"), os.path.expanduser("~/client_names.txt"))
    if warning:
        say(f"warning: {warning}")
    reporter = None if a.offline else next(iter(extractors.REPORTERS.values()), None)
    if reporter is None:
        say("warning: local detection only, " + ("as --offline asks" if a.offline else "no reporter is registered"))
    if a.ignore_verify_failure:
        say("warning: documents that fail verification will be kept")
    config = EngineConfig(companies=names, offline=a.offline, ignore_verify_failure=a.ignore_verify_failure)
    try:
        inputs = files.resolve(spark, a.input)
    except FileNotFoundError as e:
        say(f"error: {e}")
        return 1
    done = redact_documents(files.texts(inputs), config, reporter, a.render)
    results = sinks.guard(done, sinks.existing(spark, a.output)).persist()  # files are written from it after the counts
    try:
        written = sinks.write_files(results, a.output).persist()
        bad = written.where("NOT written").select("output_path", F.col("reason").alias("_why"))
        results_now = results.join(bad, "output_path", "left").withColumns({"status": F.when(F.col("_why").isNotNull(), "failed").otherwise(F.col("status")), "reason": F.coalesce("_why", "reason")}).drop("_why")
        for r in with_progress(results_now.withColumn("reason", F.coalesce("reason", "warning"))).orderBy("relative").toLocalIterator():
            print(f"{r['index']} ({r.percent}%) {r.status}: {r.relative}" + (f" ({r.reason})" if r.reason else ""))
        s, u = batch_summary(results_now.select("status")).first(), usage_totals(results).first()
    finally:
        results.unpersist()
    print(f"{s.succeeded} succeeded, {s.failed} failed, {s.total} in all; {u.calls} calls, {u.input_tokens} tokens in, {u.output_tokens} out")
    return s.exit_code


if __name__ == "__main__":
    sys.exit(main())

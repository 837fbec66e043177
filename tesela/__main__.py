"""python -m tesela COMMAND BUNDLE ...: the library's operations on a folder of documents, for people at a terminal."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession


def _bundle(spark, root: str):
    from .plans.contract import Contract
    from .scratch import read_text
    from .sources.bundle import Bundle, files

    own = read_text(spark, f"{root}/schema.json")
    return Bundle(files(spark, root), Contract().extended(own) if own else Contract())


def validate(spark, a) -> int:
    from .plans import rules, upkeep

    found = rules.findings(_bundle(spark, a.bundle), a.now, a.staged or None)
    for r in (upkeep.as_json(found) if a.json else found).toLocalIterator():
        print(r.finding if a.json else f"{r.severity}: {r.path}{f':{r.line}' if r.line else ''}: {r.rule}: {r.message}")
    return int(not found.filter("severity = 'error'").isEmpty())


def report(spark, a) -> int:
    from .plans import rules, upkeep

    upkeep.by_severity(rules.findings(_bundle(spark, a.bundle), a.now)).orderBy("rule").show(100, False)
    return 0


def project(spark, a) -> int:
    from .plans.incremental import Snapshots

    bundle = _bundle(spark, a.bundle)
    print(Snapshots(spark, a.to).publish(bundle, bundle.contract.tables(), a.full))
    return 0


def search(spark, a) -> int:
    from .operators.search import ranked

    bundle = _bundle(spark, a.bundle)
    titles = bundle["documentos"].select("path", "title")
    for r in ranked(bundle.busqueda, a.query, a.limit).join(titles, "path").orderBy("relevancia", "path").collect():
        print(f"{r.relevancia:.4f}\t{r.path}\t{r.title}")
    return 0


def fix(spark, a) -> int:
    from .plans import upkeep

    bundle = _bundle(spark, a.bundle)
    for r in upkeep.fixed(bundle.content, bundle.contract, a.now[:10]).toLocalIterator():
        if upkeep.write_if_changed(spark, f"{a.bundle}/{r.path}", bytes(r.content).decode("utf-8", "replace")):
            print(r.path)
    return 0


def begin(spark, a) -> int:
    from .plans import upkeep

    print("\n".join(upkeep.begin(spark, a.bundle)))
    return 0


def survey(spark, a) -> int:
    from pyspark.sql import functions as F

    from .plans import cost

    scan = cost.scanned(_bundle(spark, a.bundle).content)
    cost.model(scan.select("path", "chars", F.lit(80).alias("line"))).show(vertical=True)
    cost.catalogue(scan).orderBy("type", "field").show(500, False)
    cost.without_index(scan).orderBy("dir").show(500, False)
    return 0


def template(spark, a) -> int:
    from .plans.contract import Contract

    print(Contract().template(a.kind), end="")
    return 0


def place(spark, a) -> int:
    from .plans.contract import Contract

    found = Contract().place(a.kind, dict(x.split("=", 1) for x in a.values))
    print("\n".join(found))
    return int(len(found) != 1)


def probe(spark, a) -> int:
    from .plans import upkeep

    rows = upkeep.capabilities(spark).collect()
    print(json.dumps({r.name: r.ok for r in rows}))
    return int(not all(r.ok for r in rows))


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tesela", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)

    def command(run, *options: tuple[tuple, dict], bundle: bool = True):
        p = sub.add_parser(run.__name__)
        p.set_defaults(run=run)
        if bundle:
            p.add_argument("bundle")
        for names, more in options:
            p.add_argument(*names, **more)

    now = (("--now",), {"default": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")})
    command(validate, now, (("--json",), {"action": "store_true"}), (("--staged",), {"nargs": "*", "default": []}))
    command(report, now)
    command(project, (("--to",), {"required": True}), (("--full",), {"action": "store_true"}))
    command(search, (("query",), {}), (("--limit",), {"type": int, "default": 10}))
    command(fix, now)
    command(begin)
    command(survey)
    command(template, (("kind",), {}), bundle=False)
    command(place, (("kind",), {}), (("values",), {"nargs": "*"}), bundle=False)
    command(probe, bundle=False)
    a = parser.parse_args(words)
    spark = spark or SparkSession.builder.appName("tesela").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return a.run(spark, a)


if __name__ == "__main__":
    sys.exit(main())

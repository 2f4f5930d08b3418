"""Run one SQL query over labelled files and write its values beside their tags.

python -m provenant --table orders=parquet:/data/orders --taint orders.o_totalprice \
    --sql "select o_custkey, sum(o_totalprice) s from orders group by 1" --output parquet:/data/out
"""

import argparse

from pyspark.sql import SparkSession

from .plans.lineage import save_lineage
from .session import ProvenanceSession
from .sources import write_cells, write_flat


def main(args=None) -> None:
    p = argparse.ArgumentParser(prog="provenant", description=__doc__)
    p.add_argument("-i", "--table", action="append", required=True, metavar="NAME=FORMAT:PATH")
    p.add_argument("-t", "--taint", action="append", default=[], metavar="NAME.COLUMN[.FIELD]")
    p.add_argument("-q", "--sql", required=True)
    p.add_argument("-o", "--output", required=True, metavar="FORMAT:PATH")
    p.add_argument("--cells", action="store_true", help="write {value, tag} cells instead of c beside c__tag")
    p.add_argument("--implicit", choices=("off", "log", "strict"), default="log")
    p.add_argument("--lineage", metavar="FILE", help="write the column lineage as JSON")
    a = p.parse_args(args)
    session = ProvenanceSession(SparkSession.builder.getOrCreate(), implicit=a.implicit)
    for item in a.table:
        name, _, place = item.partition("=")
        kind, _, path = place.partition(":")
        own = [t.partition(".")[2] for t in a.taint if t.partition(".")[0] == name]
        session.read(kind, path, own).createOrReplaceTempView(name)
    query = session.spark.sql(a.sql)
    kind, _, path = a.output.partition(":")
    (write_cells if a.cells else write_flat)(session.track(query), kind, path)
    if a.lineage:
        save_lineage(query, a.lineage)


if __name__ == "__main__":
    main()

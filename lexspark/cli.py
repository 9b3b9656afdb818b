"""python -m lexspark.cli: index a document file or open a segment, search, print JSON."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.index import build_index, rejections
from .operators.search import ParseError, SearchError, search
from .schema import IndexSchema
from .sources.documents import DocumentFileError, json_result, read_documents
from .sources.segments import StorageError, open_segment, write_segment


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done; 2: the documents, segment or arguments are wrong; 3: the query is."""
    parser = argparse.ArgumentParser(prog="lexspark")
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--documents")
    source.add_argument("--segment")
    parser.add_argument("--write-segment")
    parser.add_argument("--query")
    parser.add_argument("--top-k", type=int, default=10)
    try:
        a = parser.parse_args(arguments)
    except SystemExit as e:
        return 2 if e.code else 0
    if a.top_k <= 0 or not (a.query or a.write_segment):
        print("a positive --top-k and a --query or --write-segment are needed", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("lexspark").getOrCreate()
    schema = IndexSchema.default()
    try:
        if a.segment:
            index = open_segment(spark, a.segment)
        else:
            mutations = read_documents(spark, a.documents)
            refused = rejections(mutations, schema).orderBy("seq").first()
            if refused is not None:
                print(f"{refused['doc_id']}: {refused['code']}", file=sys.stderr)
                return 2
            index = build_index(mutations, schema).persist()
        broken = index.violations().where("n > 0").first()
        if broken is not None:
            print(f"unsound index: {broken['invariant']}", file=sys.stderr)
            return 2
        if a.write_segment:
            write_segment(index, a.write_segment, 1)
    except (DocumentFileError, StorageError) as e:
        print(e, file=sys.stderr)
        return 2
    if a.query:
        try:
            print(json_result(search(index, a.query, a.top_k), index.live_count, index.docs))
        except (ParseError, SearchError) as e:
            print(e, file=sys.stderr)
            return 3
    return 0


if __name__ == "__main__":
    sys.exit(main())

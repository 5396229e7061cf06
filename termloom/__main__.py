"""python -m termloom: tags a corpus of files and writes mentions, scores of pairs and sentences."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from termloom import ship
from termloom.plans.programs import Corpus, Options, tag_corpus, write_tagged


def main() -> None:
    p = argparse.ArgumentParser(prog="termloom", description=__doc__)
    p.add_argument("--documents", required=True, help="TAB-separated corpus, a file or folder, also compressed")
    p.add_argument("--entities", required=True)
    p.add_argument("--names", required=True)
    for name in ("types", "stop-global", "stop-local", "groups", "type-pairs"):
        p.add_argument(f"--{name}")
    p.add_argument("--auto-detect", action="store_true", help="types of the organisms a document names, besides those given")
    p.add_argument("--characters", action="store_true", help="each byte is a token")
    p.add_argument("--max-tokens", type=int, default=Options.max_tokens)
    for name in ("document-weight", "paragraph-weight", "sentence-weight", "power"):
        p.add_argument(f"--{name}", type=float, default=getattr(Options, name.replace("-", "_")))
    for name in ("mentions", "pairs", "segments"):
        p.add_argument(f"--out-{name}")
    a = p.parse_args()
    spark = SparkSession.builder.appName("termloom").getOrCreate()
    ship(spark)
    corpus = Corpus(a.documents, a.entities, a.names, a.types, a.stop_global, a.stop_local, a.groups, a.type_pairs)
    options = Options(a.auto_detect, a.characters, a.max_tokens, a.document_weight, a.paragraph_weight, a.sentence_weight, a.power)
    tagged = tag_corpus(spark, corpus, options)
    write_tagged(tagged, a.out_mentions, a.out_pairs, a.out_segments)
    print(f"{tagged.progress.get['documents']} documents")


if __name__ == "__main__":
    main()

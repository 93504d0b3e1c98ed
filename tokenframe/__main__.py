"""python -m tokenframe: encode, decode, chat, info and bench over files.

    encode --vocab tokenizer.json --inputs a.txt,b.txt --out DIR    ids of each file as Parquet (path, ids)
    decode --vocab tokenizer.json --inputs x.ids                    text of raw little-endian 32-bit ids, to stdout
    chat   --vocab tokenizer.json --inputs chat.json [--prompt]     ids of a conversation in JSON, to stdout
    info   --vocab tokenizer.json                                   what the vocabulary is, as JSON
    bench  --vocab tokenizer.json --input-list paths.txt            metric rows as CSV, to stdout
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import chat, specials
from .operators.decode import decode
from .operators.encode import encode
from .plans import metrics
from .sources import files
from .sources.vocabulary import load


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tokenframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=("encode", "decode", "chat", "info", "bench"))
    p.add_argument("--vocab", required=True)
    p.add_argument("--inputs", default="", help="paths with commas between")
    p.add_argument("--input-list", help="a file of paths, one a line")
    p.add_argument("--out")
    p.add_argument("--add-bos", action="store_true")
    p.add_argument("--add-eos", action="store_true")
    p.add_argument("--prompt", action="store_true", help="end a chat with the opening of an answer")
    p.add_argument("--errors", default="strict", choices=("strict", "replace"))
    p.add_argument("--runs", type=int, default=3)
    p.add_argument("--warmup", type=int, default=1)
    a = p.parse_args(args)
    vocab = load(a.vocab)
    if a.command == "info":
        print(json.dumps(vocab.describe(), indent=1))
        return 0
    paths = [x for x in a.inputs.split(",") if x]
    if a.input_list:
        with open(a.input_list, encoding="utf-8") as f:
            paths += files.path_list(f.read())
    if not paths:
        p.error("no inputs")
    spark = SparkSession.builder.appName("tokenframe").getOrCreate()
    if a.command == "bench":
        sys.stdout.write(metrics.to_csv(metrics.encode_metrics(spark, vocab, paths, a.runs, a.warmup)))
    elif a.command == "decode":
        for row in decode(files.id_files(spark, paths), vocab, errors=a.errors).orderBy("path").toLocalIterator():
            print(row["text"])
    elif a.command == "chat":
        turns = files.text_files(spark, paths).select("doc_pos", chat.chat_json(F.col("text")).alias("turns"))
        for row in chat.encode_chat(turns, vocab, generation_prompt=a.prompt).orderBy("doc_pos").toLocalIterator():
            print(" ".join(map(str, row["ids"])))
    else:
        encoded = encode(files.text_files(spark, paths), vocab).withColumn("ids", specials.add_bos_eos(F.col("ids"), vocab, a.add_bos, a.add_eos)).select("doc_pos", "path", "ids")
        if a.out:
            encoded.write.parquet(a.out)
        else:
            for row in encoded.orderBy("doc_pos").toLocalIterator():
                print(" ".join(map(str, row["ids"])))
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Command line: compress a data set, decompress it, code it another way.

Predictive encoders can keep their features and model (``--save-state``) and start from kept
ones (``--features``, ``--model``).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from brindle.operators import shape
from brindle.plans import container, predictive
from brindle.sources import readers


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="brindle")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compress")
    c.add_argument("dataset", help="test, test-rgb, npy, mnist, cifar-10, adult")
    c.add_argument("out")
    c.add_argument("--path")
    c.add_argument("--pre", choices=container.PREPROCESSORS, default="none")
    c.add_argument("--psz", type=int, default=2)
    c.add_argument("--side", type=int, default=4)
    c.add_argument("--comp", choices=container.ORDERS, default="mst")
    c.add_argument("--enc", choices=container.ENCODERS, default="delta-huff")
    c.add_argument("--metric", choices=["l2", "l1", "hamming"], default="l2")
    c.add_argument("--words", type=int, default=12, help="words of the dictionary")
    c.add_argument("--channels", type=int, default=1)
    c.add_argument("--family", choices=predictive.MODELS, default="linear")
    c.add_argument("--context", choices=list(shape.CONTEXTS), default="DAB")
    c.add_argument("--prev-context", choices=list(shape.CONTEXTS), default="DABX")
    c.add_argument("--prev", type=int, default=1, help="images before that a prediction sees")
    c.add_argument("--restart", type=int, default=1024)
    c.add_argument("--features", help="features kept by an earlier run")
    c.add_argument("--model", help="a model kept by an earlier run")
    c.add_argument("--save-state", help="where to keep features and model")
    d = sub.add_parser("decompress")
    d.add_argument("container")
    d.add_argument("out")
    d.add_argument("--post", action="store_true", help="undo the preprocessing as well")
    r = sub.add_parser("recode")
    r.add_argument("container")
    r.add_argument("out")
    r.add_argument("--enc", choices=container.ENCODERS, required=True)
    a = top.parse_args(args)
    spark = SparkSession.builder.appName("brindle").getOrCreate()
    if a.command == "compress":
        df = readers.load(spark, a.dataset, a.path)
        if a.enc in predictive.ENCODERS:
            if a.pre != "none":
                raise SystemExit(f"{a.enc} takes whole images, without --pre")
            settings = predictive.Settings(a.side, a.side, a.channels, a.context, a.prev_context, a.prev, a.restart)
            model = predictive.load_model(spark, a.model) if a.model else None
            features = spark.read.parquet(a.features) if a.features else None
            if a.save_state:
                place = container.order_elements(df, a.comp, a.metric)
                placed = place.join(df, ["layer", "elem"]).select("pos", "px")
                features = features or predictive.contexts(placed, settings)
                features.write.parquet(f"{a.save_state}/features")
                features = spark.read.parquet(f"{a.save_state}/features")
                model = model or predictive.train(features, settings, a.family)
                predictive.save_model(spark, model, f"{a.save_state}/model")
            container.compress(df, a.out, a.comp, a.enc, a.metric, settings, a.family, model, features)
        else:
            df, state = container.preprocess(df, a.pre, a.side, a.psz, a.words)
            container.compress(df, a.out, a.comp, a.enc, a.metric)
            spark.createDataFrame([(json.dumps(state),)], "state string").write.parquet(f"{a.out}/preprocessing")
    elif a.command == "decompress":
        df = container.decompress(spark, a.container)
        if a.post:
            df = container.postprocess(df, json.loads(spark.read.parquet(f"{a.container}/preprocessing").first()["state"]))
        df.write.parquet(a.out)
    else:
        container.recode(spark, a.container, a.out, a.enc)


if __name__ == "__main__":
    main()

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.cli import main
from brindle.operators import predict, shape
from brindle.plans import container, predictive
from brindle.plans.catalog import ordered_images
from brindle.sources import readers

SF = "/root/testdata/sf0.001"


def images(n, size, seed=1):
    r = np.random.default_rng(seed)
    base = np.cumsum(r.integers(-9, 10, (n, size)), axis=1)
    return [(k, [int(v) for v in row % 256]) for k, row in enumerate(base)]


@pytest.mark.parametrize(("encoder", "n"), [(e, n) for e in predictive.ENCODERS for n in (0, 1, 2, 5, 13)])
def test_chains_of_all_lengths(spark, tmp_path, encoder, n):
    df = spark.createDataFrame(images(n, 20), "pos long, px array<int>")
    s = predictive.Settings(4, 5, 1, "DABC", "DABX", 2, 4)
    predictive.compress(df, str(tmp_path / "c"), s, encoder, model={"family": "linear", "models": [[0.1] * s.features + [0.5]]})
    back = predictive.decompress(spark, str(tmp_path / "c"))
    assert {r["pos"]: r["px"] for r in back.collect()} == dict(images(n, 20))


def test_contexts_like_plain_ones(spark):
    rows, cols, ch = 3, 4, 3
    px = dict(images(7, rows * cols * ch))
    s = predictive.Settings(rows, cols, ch, "DAB", "DABX", 1, 3)
    at = lambda k, r, c, q: px[k][(r * cols + c) * ch + q]
    want, seq = [], 0
    for k in range(7):
        if k % 3 < 1:
            continue
        for r in range(1, rows):
            for c in range(1, cols):
                x = [at(k, r + i, c + j, q) for i, j in shape.CONTEXTS["DAB"] for q in range(ch)] + [at(k - 1, r + i, c + j, q) for i, j in shape.CONTEXTS["DABX"] for q in range(ch)]
                for q in range(ch):
                    want.append((seq, q, x, at(k, r, c, q)))
                    seq += 1
    got = predictive.contexts(spark.createDataFrame(list(px.items()), "pos long, px array<int>"), s)
    assert sorted(tuple(r) for r in got.collect()) == want
    rest = predictive.residuals(spark.createDataFrame(list(px.items()), "pos long, px array<int>"), s)
    assert sorted(r["seq"] for r in rest.collect()) == list(range(7 * rows * cols * ch - seq))


@pytest.mark.parametrize("family", predictive.MODELS)
def test_both_sides_predict_alike(spark, family):
    s = predictive.Settings(8, 8, 1, "DAB", "DAB", 1, 0)
    f = predictive.contexts(ordered_images(spark, SF).select("pos", "px"), s).cache()
    model = predictive.train(f, s, family)
    got = predictive.predicted(f, model).select("x", "p").collect()
    assert [r["p"] for r in got] == predictive.values(model, 0, np.array([r["x"] for r in got], float)).tolist()


def test_logistic_accuracy_is_that_of_the_model(spark):
    f = shape.features(ordered_images(spark, SF), 8, 8, "DAB", "DAB", 0).cache()
    model = predict.logistic_model(f, 3, 5)
    rows = f.collect()
    x, y = np.array([r["x"] for r in rows], float), np.array([r["y"] for r in rows])
    margin = (x / 255) @ np.array(model["coef"]).T + np.array(model["intercept"])
    got = predict.accuracy(predict.logistic_predictions(f, 3, 5)).first()
    assert got["n"] == len(rows) and got["accuracy"] == pytest.approx((margin.argmax(axis=1) == y).mean(), abs=2e-4)


def test_rules_like_plain_ones(spark):
    f = shape.features(ordered_images(spark, SF), 8, 8, "DAB", "DAB", 0).cache()
    rules = predict.model_tree(f, 3, 2)
    rows = predict.errors(f, predict.rules_value(F.col("x"), rules)).collect()
    for r in rows[::50]:
        held = [m for conditions, m in rules if all((r["x"][k] <= t) if op == "<=" else (r["x"][k] > t) for k, op, t in conditions)]
        assert len(held) == 1  # leaves part the features
        v = sum(a * b for a, b in zip(r["x"], held[0])) + held[0][-1]
        assert abs(r["p"] - min(max(v, 0), 255)) < 1.0001 and r["e"] == (r["y"] - r["p"]) % 256
    # each leaf's model has least squares there
    conditions, m = rules[0]
    own = np.array([[*r["x"], 1, r["y"]] for r in rows if all((r["x"][k] <= t) if op == "<=" else (r["x"][k] > t) for k, op, t in conditions)], float)
    assert np.allclose(np.linalg.lstsq(own[:, :4], own[:, 4], rcond=None)[0], m, atol=1e-6)


def test_external_sizes_like_plain_ones(spark):
    import bz2
    import gzip
    import lzma

    rows = [("a" * 500, 1), (None, 2), ("", 3), ("hällo wörld " * 40, 4)]
    got = {r["k"]: tuple(r[c] for c in ("raw", "gz", "bz2", "xz")) for r in predict.compressed_size(spark.createDataFrame(rows, "text string, k int"), "text").collect()}
    for t, k in rows:
        raw = (t or "").encode()
        assert got[k] == (len(raw), len(gzip.compress(raw, 9, mtime=0)), len(bz2.compress(raw)), len(lzma.compress(raw)))


def test_command_line(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    main(["compress", "test", at("c"), "--enc", "pred-huff", "--comp", "id", "--prev", "1", "--restart", "3", "--save-state", at("state")])
    main(["recode", at("c"), at("d"), "--enc", "pred-golomb"])
    main(["decompress", at("d"), at("e")])
    assert container.differences(spark.read.parquet(at("e")), readers.grey_fixture(spark)) == 0
    main(["compress", "test", at("f"), "--enc", "pred-huff-run", "--comp", "id", "--prev", "1", "--restart", "3", "--features", at("state/features"), "--model", at("state/model")])
    assert container.differences(container.decompress(spark, at("f")), readers.grey_fixture(spark)) == 0


@pytest.mark.parametrize("how", ["none", "sqpatch", "rgb", "rgb-sqpatch"])
def test_preprocessors_are_undone(spark, how):
    df = readers.colour_fixture(spark) if how.startswith("rgb") else readers.grey_fixture(spark)
    made, state = container.preprocess(df, how, 4, 2)
    assert container.differences(container.postprocess(made, state), df) == 0


def test_dictionary_preprocessor(spark):
    df = readers.grey_fixture(spark)
    made, state = container.preprocess(df, "dict", words=4)
    back = {r["elem"]: r["px"] for r in container.postprocess(made, state).collect()}
    codes = {r["elem"]: r["px"] for r in made.collect()}
    words = np.array(state["words"])
    assert all(back[i] == [int(v) % 256 for v in np.floor(np.array(c, float) @ words)] for i, c in codes.items())


def test_channels_as_columns_of_a_model(spark, tmp_path):
    df = spark.createDataFrame(images(6, 48), "pos long, px array<int>")
    s = predictive.Settings(4, 4, 3, "DAB", "DAB", 1, 0)
    predictive.compress(df, str(tmp_path / "c"), s)
    assert {r["pos"]: r["px"] for r in predictive.decompress(spark, str(tmp_path / "c")).collect()} == dict(images(6, 48))


def test_unknown_names_are_refused(spark):
    df = readers.grey_fixture(spark)
    with pytest.raises(ValueError, match="no encoder"):
        container.compress(df, "/nowhere", encoder="x")
    with pytest.raises(ValueError, match="no preprocessor"):
        container.preprocess(df, "x")
    with pytest.raises(ValueError, match="needs settings"):
        container.compress(df, "/nowhere", "id", "pred-huff")
    with pytest.raises(ValueError, match="none to predict"):
        predictive.Settings(4, 4, n_previous=2, restart=2)

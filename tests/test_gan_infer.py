"""Signals of windows are those of the whole forward pass, and rows of windows go to Spark but once."""

import numpy as np
from pulsegrid.gan import infer, model
from pulsegrid.operators import train
from pulsegrid.plans import fixtures as X
from pulsegrid.plans.queries import COMPILED, QUERIES

SF = "/root/testdata/sf0.001"


def test_outputs_are_those_of_the_forward_pass():
    r = np.random.default_rng(3)
    fresh, trained = model.new_generator(seed=1), model.new_generator(noise=6, embed=10, hidden=24, ids=np.arange(0, 4**11, 997), seed=4)
    for k in trained.p:  # nothing is left as it begins
        trained.p[k] = trained.p[k] + 0.3 * r.normal(size=trained.p[k].shape)
    trained.p["g0"][:3] *= -1
    half = model.new_generator(ids=np.arange(100), seed=2)
    half.p["b1"] += 0.5
    for net in (fresh, trained, half):
        kmers, meths = np.concatenate((np.arange(150), r.integers(0, 4**11, 4000), np.arange(0, 997 * 50, 997))), r.integers(0, 4, 4200)
        x = model.noises(model.mix(np.arange(4200, dtype=np.uint64)), net.noise, 0)
        np.testing.assert_allclose(net.infer(x, kmers, meths, net.ready()), net.forward(x, kmers, meths)[0], rtol=2e-3, atol=2e-4)
        assert net.embed.single(kmers).dtype == np.float32


def test_windows_cross_to_python_once(spark):
    plan = QUERIES["gan_generate"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "transform" not in plan


def test_rows_are_those_of_samples(spark):
    net, few = model.new_generator(seed=1), X.reads(spark, SF).where("doc_id < 30")
    want = infer.generate(train.samples(few, COMPILED, ["doc_id"]).select("doc_id", "pos", "kmer", "meth_id"), net)
    got = infer.generate_samples(few, COMPILED, ["doc_id"], net)
    assert got.dtypes == want.dtypes and got.count() > 1000
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

"""The criterion chooses the size of the mixture."""

import numpy as np

from siftline.llm import mixture


def test_more_families_than_sixteen(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(40):
        sections, entropy, size, imports = int(rng.integers(1, 40)), rng.uniform(0.5, 7.5), rng.uniform(5, 14), int(rng.integers(0, 400))
        for j in range(30):
            rows.append((100 * i + j, sections, float(entropy + rng.normal(0, 0.05)), int(np.exp(size + rng.normal(0, 0.05))), imports + int(rng.integers(0, 4))))
    df = spark.createDataFrame(rows, "sample_id bigint, number_of_sections bigint, sec_entropy_text double, size_code bigint, number_of_import_symbols bigint")
    got = mixture.clusters(df).collect()
    assert len(got) > 16 and sum(r["size"] for r in got) == len(rows)
    x = mixture.vectors(mixture.samples_of(df))
    best = mixture.chosen(x)
    half, twice = (mixture.fits(x, ("x0", "x1", "x2", "x3"), (k,), 7, mixture.LIMIT)[0] for k in (len(best.means) // 2, 2 * len(best.means)))
    assert best.bic < half.bic and best.bic <= twice.bic


def test_products_give_the_same_densities():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(20, 3, 3))
    m = mixture.Mixture(np.zeros(3), np.eye(3), rng.normal(size=(20, 3)), a @ a.transpose(0, 2, 1) + np.eye(3), rng.normal(size=20))
    p = rng.normal(size=(50, 3))
    d = p[:, None, :] - m.means
    assert np.allclose(m.log_density(p), m.offsets - 0.5 * np.einsum("nki,kij,nkj->nk", d, m.precisions, d))

"""A bucket that can't be read fails a commit; it is not written as the new state."""

import os
import shutil

import pytest

from arboria.plans.api import Engine


def _tree(folder, n):
    folder.mkdir()
    for i in range(n):
        (folder / f"m{i}.py").write_text(f"def f{folder.name}{i}():\n    return {i}\n")
    return str(folder)


def _ids(engine):
    return sorted(r.id for r in engine.nodes().select("id").collect())


def test_no_commit_takes_a_loss_for_the_state(spark, tmp_path):
    a, b = _tree(tmp_path / "a", 4), _tree(tmp_path / "b", 2)
    engine = Engine(spark, str(tmp_path / "graph"))
    engine.index(a)
    before = _ids(engine)
    base = tmp_path / "graph" / "nodes"
    file = next(os.path.join(d, f) for d, _, fs in sorted(os.walk(base)) for f in sorted(fs) if f.endswith(".parquet"))
    shutil.copy(file, tmp_path / "kept")
    for damage in (lambda: open(file, "wb").write(b"damaged"), lambda: os.remove(file), lambda: shutil.rmtree(os.path.dirname(file))):
        folder = os.path.dirname(file)
        damage()
        crc = os.path.join(folder, f".{os.path.basename(file)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
        spark.catalog.clearCache()
        assert len(_ids(engine)) < len(before)  # queries do without it
        with pytest.raises(Exception):
            engine.index(b)
        os.makedirs(folder, exist_ok=True)
        shutil.copy(tmp_path / "kept", file)
        assert _ids(engine) == before
    engine.index(b)
    assert set(before) <= set(_ids(engine))
    with open(next(os.path.join(d, f) for d, _, fs in sorted(os.walk(base)) for f in sorted(fs) if f.endswith(".parquet")), "wb") as f:
        f.write(b"damaged for good")
    assert engine.store.repair()["nodes"]
    engine.index(a)
    engine.index(b)
    assert set(before) <= set(_ids(engine))

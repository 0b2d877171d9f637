from concurrent.futures import ThreadPoolExecutor

import pytest

from lodestrata.operators import features, learning, versions


@pytest.fixture(scope="module")
def rows(spark):
    size = len(features.NAMES)
    return spark.createDataFrame([(label, [float(i + k)] * size) for i in range(12) for k, label in ((0, "entity"), (50, "enum"))], "label string, feature_vector array<double>")


@pytest.fixture(scope="module")
def model(rows):
    return learning.train(rows, trees=3)


@pytest.fixture
def few_trees(monkeypatch):
    train = learning.train
    monkeypatch.setattr(learning, "train", lambda data: train(data, trees=3))


def test_versions_follow_one_another(spark, rows, tmp_path, few_trees):
    """Enough corrections make a version, too few new ones none; a forced run counts what it has."""
    folder, source = str(tmp_path), "a/b %2F .."
    assert versions.latest(folder, source) is None and versions.model_of(None) is None
    state, first = versions.retrained(spark, folder, source, rows, rows.limit(10))
    assert state == versions.DONE and (first["version"], first["correction_count"], first["training_samples"], first["model_status"]) == (1, 10, 34, "trained")
    assert versions.retrained(spark, folder, source, rows, rows.limit(19)) == (versions.DONE, first)
    assert versions.retrained(spark, folder, source, rows, rows.limit(20), dry_run=True) == (versions.DONE, first)
    state, second = versions.retrained(spark, folder, source, rows, rows.limit(3), force=True)
    assert state == versions.DONE and (second["version"], second["correction_count"], second["training_samples"]) == (2, 3, 27)
    assert versions.latest(folder, source) == second and versions.latest(folder, "other") is None
    assert {r.label for r in learning.predict(versions.model_of(second), rows.select("feature_vector")).select("label").collect()} == {"entity", "enum"}


def test_states_that_leave_no_version(spark, rows, tmp_path, monkeypatch):
    folder = str(tmp_path)
    assert versions.retrained(spark, folder, "s", rows, rows.limit(9)) == (versions.TOO_FEW, None)
    assert versions.retrained(spark, folder, "s", rows.limit(0), rows) == (versions.NO_EXAMPLES, None)
    assert versions.retrained(spark, folder, "s", rows.limit(0), rows, dry_run=True) == (versions.NO_EXAMPLES, None)

    def broken(error):
        def train(_):
            raise error

        return train

    for error, state in ((ImportError("none"), versions.NO_LIBRARY), (ValueError("odd"), versions.FAILED)):
        monkeypatch.setattr(learning, "train", broken(error))
        assert versions.retrained(spark, folder, "s", rows, rows) == (state, None)
    assert versions.latest(folder, "s") is None


def test_of_two_writers_one_wins(spark, model, tmp_path):
    """Writers that began at the same version: one gets the next, the others nothing, and readers see whole records."""
    folder = f"file://{tmp_path}"
    for expected in (0, 1):
        with ThreadPoolExecutor(4) as pool:
            made = list(pool.map(lambda i: versions.commit(spark, folder, "s", model, {"writer": i}, expected), range(4)))
        won = [m for m in made if m]
        assert len(won) == 1 and versions.latest(folder, "s") == won[0] and won[0]["version"] == expected + 1


def test_a_retrain_that_comes_second_is_lost(spark, rows, model, tmp_path, monkeypatch):
    folder = str(tmp_path)

    def train(_):
        versions.commit(spark, folder, "s", model, {"correction_count": 0}, 0)  # another writer is first
        return model

    monkeypatch.setattr(learning, "train", train)
    state, record = versions.retrained(spark, folder, "s", rows, rows)
    assert state == versions.LOST and record == versions.latest(folder, "s") and record["version"] == 1 and record["correction_count"] == 0


def test_renaming_does_not_overwrite(spark, tmp_path):
    """The step taken where there are no hard links, here on local files."""
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("first")
    assert versions.renamed(spark, f"file://{a}", f"file://{b}") and not a.exists()
    a.write_text("second")
    assert not versions.renamed(spark, f"file://{a}", f"file://{b}") and (a.read_text(), b.read_text()) == ("second", "first")

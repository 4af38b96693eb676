"""Prompt catalogs from a folder, and lines of a report."""

import pytest

from sightline.operators import reports
from sightline.sources.files import PROMPT_FOLDER, prompt_fragments, prompt_paths


def write(path, agent, text):
    path.write_text(f'agent = "{agent}"\n[intro]\neditable = true\ntext = "{text}"\n')
    return str(path)


def test_catalogs_from_a_folder(spark, tmp_path, monkeypatch):
    own = write(tmp_path / "own.toml", "vision", "hello {name}")
    folder = tmp_path / "other"
    folder.mkdir()
    monkeypatch.delenv(PROMPT_FOLDER, raising=False)
    assert prompt_paths([own]) == [own]
    monkeypatch.setenv(PROMPT_FOLDER, str(folder))
    with pytest.raises(FileNotFoundError):
        prompt_paths([own])
    write(folder / "a.toml", "vision", "first")
    write(folder / "b.toml", "vision", "hi {name} on {day}")
    (folder / "notes.txt").write_text("no catalog")
    rows = prompt_fragments(spark, prompt_paths([own]), {"name", "day"}).collect()
    assert [(r.agent, r.fragment, r.text, sorted(r.names)) for r in rows] == [("vision", "intro", "hi {name} on {day}", ["day", "name"])]
    with pytest.raises(ValueError, match="day"):
        prompt_fragments(spark, prompt_paths([own]), {"name"})


def test_lines_of_a_report(spark):
    rows = [("a", 1, "x", 2, 3, 4, False), ("a", 2, "x", 2, 3, 5, False), ("a", 1, "y", 1, 2, 1, False), ("a", 2, "y", 0, 2, 0, True), ("a", 1, "z", 0, 0, 7, True), ("a", 2, "z", 0, 0, 9, True)]
    df = spark.createDataFrame(rows, "variant string, run int, video string, matched long, truth long, produced long, error boolean")
    got = {}
    for r in reports.report_lines(df).orderBy("section", "place").collect():
        got.setdefault(r.section, []).append(r.line)
    assert got == {
        "compared": ["| `a` | 2.5/5 | 2–3 | 3/6 | 13.0 |"],
        "stability": ["- always an error (1): z", "- stable (1): x", "- volatile (1): y (1–1)"],
        "false_alarms": ["| z | error, error |"],
        "runs": ["| x | 2/3 (4) | 2/3 (5) |", "| y | 1/2 (1) | **error** |", "| z | **error** | **error** |"],
    }

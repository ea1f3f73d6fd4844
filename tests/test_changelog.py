from skarn.operators import changelog


def test_categories(spark, tmp_path):
    lines = ["a1 feat(x): one", "b2 Fix: two", "c3 other", "d4 Merge pull request #3 from me/some-new-Thing", "e5 Merge branch 'x'", "f6"]
    rows = changelog.categorised(spark.createDataFrame(list(enumerate(lines)), "ord int, line string")).orderBy("ord").collect()
    assert [(r["category"][-8:], r["entry"]) for r in rows] == [("Features", "- feat(x): one (a1)"), ("ug Fixes", "- Fix: two (b2)"), ("ntenance", "- other (c3)"), ("ntenance", "- Some new thing")]
    text = changelog.changelog("v2", rows)
    assert "## Release v2" in text and text.index("Features") < text.index("Bug Fixes") < text.index("Maintenance")
    assert "No changes" in changelog.changelog("v1", [])
    assert changelog.commits(spark, str(tmp_path))[1].count() == 0


def test_heading_and_lead():
    rows = [{"category": changelog.FEATURES, "entry": "- feat: a (1)"}]
    assert changelog.changelog("v1", rows, "Notes:", "All about a.").splitlines()[:3] == ["## Notes: v1", "", "All about a."]

"""Text reports line by line, on a few rows worked out by hand."""

import pytest

from review_insights.operators import benchmark, patterns, priority, reports, roi

SCHEMA = "rating double, sentiment_label string, bert_sentiment string, bert_confidence double, problem_category string"
ROWS = ([(5.0, "positive", "positive", 0.9, "none")] * 6 + [(1.0, "negative", "negative", 0.8, "taste")] * 3
        + [(2.0, "negative", "negative", 0.7, "shipping")])


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def texts(lines):
    return [r["text"] for r in lines.orderBy("section", "ord").collect()]


def test_business_report(scored):
    metrics = benchmark.benchmark_metrics(scored)
    probs = patterns.problem_analysis(scored)
    prio = priority.priority_scores(probs)
    sug = priority.improvement_suggestions(prio)
    rc = roi.roi_by_category(sug)
    lines = texts(reports.business_report_lines(metrics, sug, rc, roi.roi_overall(rc), benchmark.competitive_position(scored, probs, prio, metrics),
                                                "2024-01-31 12:00:00", title="A title"))
    assert lines[:6] == ["A title", "生成日時: 2024-01-31 12:00:00", "エグゼクティブサマリー", "総レビュー数: 10件",
                         "ネガティブレビュー: 4件 (40.0%)", "平均評価: 3.50/5.0"]
    at = lines.index
    assert lines[6].startswith("最優先改善項目: ") and lines[7].startswith("推定投資額: $") and at("改善提案詳細（優先度順）") == 8
    assert lines[9].startswith("1. ") and at("ROI・投資対効果分析") - 8 - 1 == sug.count()
    assert lines[at("競合比較・市場ポジション") + 1] == "現在のポジション: 50%ile | 業界平均評価: 3.50 | ネガティブ率: 40.0%"
    assert lines[at("強み:") + 1] == "• 高評価レビューの多さ" and at("強み:") < at("弱み:") < at("改善機会:")
    assert lines[at("弱み:") + 1:at("改善機会:")] == ["• 味・風味改善の課題", "• 配送・梱包改善の課題"]
    assert lines[at("改善機会:") + 2] == "• ネガティブレビュー削減による評価向上"
    assert lines[at("実装ロードマップ") + 1].startswith("フェーズ1 (最初の3ヶ月): ")
    assert lines[at("成功指標・KPI") + 1:] == ["平均評価: 3.50 → 4.00", "ネガティブ率: 40.0% → 35.0%", "5星評価率: +10%向上", "顧客満足度: +15%向上"]


def test_scoring_report(spark, scored):
    terms = spark.createDataFrame([("negative", 2, "stale"), ("negative", 1, "bad"), ("positive", 1, "good"), ("positive", 6, "late")],
                                  "sentiment string, rank long, term string")
    assert texts(reports.scoring_report_lines(reports.scoring_report(scored, with_accuracy=True, keywords=terms))) == [
        "レビュー感情分析 - サマリーレポート", "基本統計:", "総レビュー数: 10件", "分析完了率: 100.0%",
        "感情分析結果:", "positive: 6件 (60.0%)", "negative: 4件 (40.0%)", "平均信頼度: 0.850",
        "精度評価:", "全体精度: 1.000 (100.0%)",
        "ネガティブレビュー分析:", "ネガティブレビュー: 4件 (40.0%)", "主要問題:", "- taste: 3件 (75.0%)", "- shipping: 1件 (25.0%)",
        "キーワード分析:", "negativeの主要キーワード: bad, stale", "positiveの主要キーワード: good",
        "次のステップ (Phase 3):", "1. 改善提案エンジンの実装", "2. ROI算出システムの構築", "3. 競合比較機能の追加", "4. Webアプリケーション開発"]


def test_scoring_report_leaves_out_what_is_absent(spark):
    rows = spark.createDataFrame([(5.0, None, "positive", 0.9, "none")] * 2, SCHEMA)
    lines = texts(reports.scoring_report_lines(reports.scoring_report(rows)))
    assert "精度評価:" not in lines and "主要問題:" not in lines and "キーワード分析:" not in lines
    assert lines[lines.index("感情分析結果:") + 1] == "positive: 2件 (100.0%)"


def test_dashboard_summary(scored):
    assert texts(reports.dashboard_summary_lines(scored, "2024-01-31 12:00")) == [
        "# レビュー分析 - サマリーレポート", "## 分析概要", "- 総レビュー数: 10件", "- 分析日時: 2024-01-31 12:00", "## 感情分析結果",
        "- positive: 6件 (60.0%)", "- negative: 4件 (40.0%)"]
    assert texts(reports.dashboard_summary_lines(scored.limit(0), "now"))[2] == "- 総レビュー数: 0件"

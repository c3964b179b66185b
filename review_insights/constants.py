"""Fixed values that must equal the original analysis for results to agree.

Everything in this module is data, not logic: keyword lists, label names,
template texts and cost figures, thresholds and override constants.  They are
stated once, in their natural order, and every operator reads them from here.
"""

from __future__ import annotations

# --- FIXED VALUES: missing-value tokens a CSV reader treats as null ---------
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- FIXED VALUES: raw column names -> conformed review column names --------
RENAME_MAP = {
    "Id": "review_id",
    "ProductId": "product_id",
    "UserId": "user_id",
    "Score": "rating",
    "Summary": "review_title",
    "Text": "review_text",
    "Time": "review_date",
}

DEFAULT_RATING = 5
DEFAULT_REVIEW_TEXT = "No review text available"
PRODUCT_ID_FORMAT = "B%06d"
UNKNOWN_PRODUCT_NAME = "Unknown Food Product"
TITLE_MIN_LENGTH = 3          # a title longer than this names the product
TITLE_MAX_CHARS = 50
SPREAD_START = "2023-01-01 00:00:00"   # date spread when no date column exists
SPREAD_END = "2024-12-31 00:00:00"

# --- FIXED VALUES: product-name keywords, scanned in this order -------------
PRODUCT_NAME_KEYWORDS = (
    "coffee", "espresso", "latte", "cappuccino",
    "tea", "green tea", "black tea", "herbal",
    "chips", "crackers", "nuts", "cookies",
    "candy", "chocolate", "gum", "sweet",
    "sauce", "pasta", "rice", "cereal",
)

# --- FIXED VALUES: category keywords (first matching group wins) ------------
CATEGORY_KEYWORDS = (
    ("beverages", ("coffee", "tea", "beverage", "drink", "juice", "soda")),
    ("snacks", ("snack", "chip", "candy", "cookie", "cracker", "nuts")),
    ("food", ("food", "sauce", "spice", "pasta", "rice", "meat")),
)
DEFAULT_CATEGORY = "food"

# --- FIXED VALUES: sentiment labels and thresholds --------------------------
POSITIVE, NEUTRAL, NEGATIVE = "positive", "neutral", "negative"
SENTIMENTS = (POSITIVE, NEGATIVE, NEUTRAL)       # order used for keyword runs
POSITIVE_MIN_RATING = 4
NEUTRAL_RATING = 3
HIGH_QUALITY_MIN_LENGTH = 20
HIGH_QUALITY_MIN_VOTES = 1
SHORT_REVIEW_LENGTH = 10
IMBALANCE_SHARE = 0.05

# --- FIXED VALUES: problem keywords; dict order is the tie-break order ------
PROBLEM_KEYWORDS = (
    ("quality", ("bad", "terrible", "awful", "poor", "worst", "horrible", "disgusting")),
    ("price", ("expensive", "overpriced", "costly", "price", "money", "cheap")),
    ("shipping", ("shipping", "delivery", "arrived", "package", "packaging")),
    ("taste", ("taste", "flavor", "bland", "bitter", "sweet", "salty")),
    ("service", ("service", "customer", "support", "help", "response")),
)
PROBLEM_OTHER = "other"
PROBLEM_NONE = "none"

# --- FIXED VALUES: TF-IDF parameters -----------------------------------------
TFIDF_MAX_FEATURES = 1000
TFIDF_MIN_DF = 5
TFIDF_MAX_DF = 0.7
TFIDF_TOP_K = 50

# --- FIXED VALUES: improvement templates ------------------------------------
# (problem_type, display category, five actions, base cost USD, impact multiplier,
#  implementation timeline); tuple order is the template order.
IMPROVEMENT_TEMPLATES = (
    ("taste", "味・風味改善",
     ("味の調整・レシピ見直し", "品質管理プロセスの強化", "原材料の見直し・グレードアップ",
      "製造工程の最適化", "味のバリエーション追加"),
     50000, 1.2, "3-6ヶ月"),
    ("quality", "品質改善",
     ("QA・検査工程の強化", "製造設備のアップグレード", "パッケージング改良",
      "保存方法・賞味期限の見直し", "サプライヤー品質基準の向上"),
     75000, 1.5, "2-4ヶ月"),
    ("price", "価格戦略",
     ("価格帯の見直し・最適化", "コストダウン施策の実施", "バリューパック・お得サイズの追加",
      "競合価格分析による戦略調整", "プロモーション・キャンペーンの実施"),
     25000, 0.8, "1-2ヶ月"),
    ("shipping", "配送・梱包改善",
     ("梱包材料・方法の改良", "配送スピードの向上", "破損防止対策の強化",
      "配送業者の見直し", "追跡システムの改善"),
     30000, 0.6, "1-3ヶ月"),
    ("service", "カスタマーサービス改善",
     ("カスタマーサポート体制の強化", "返品・交換プロセスの改善", "FAQ・ヘルプドキュメントの充実",
      "問い合わせ対応時間の短縮", "ユーザーフィードバック収集の改善"),
     40000, 0.7, "2-3ヶ月"),
)
DEFAULT_TIMELINE = "2-4ヶ月"

# --- FIXED VALUES: priority and ROI arithmetic -------------------------------
WEIGHT_FREQUENCY = 0.4
WEIGHT_INTENSITY = 0.3
WEIGHT_IMPACT = 0.2
WEIGHT_EASE = 0.1
EASE_COST_UNIT = 25000
REVENUE_PER_REVIEW_PRIORITY = 10        # $ per review in the priority ROI ratio
RISK_HIGH_COST = 60000
RISK_MID_COST = 35000
RISK_HIGH, RISK_MID, RISK_LOW = "高", "中", "低"
SUCCESS_BASE = 0.7
SUCCESS_PRIORITY_WEIGHT = 0.2
SUCCESS_ROI_WEIGHT = 0.1
SUCCESS_ROI_CAP = 0.2
SUCCESS_MAX = 0.95
REVENUE_LOSS_PER_REVIEW = 100
IMPROVEMENT_RATE = 0.85
ANNUAL_MULTIPLIER = 3

# --- FIXED VALUES: dashboard ROI override (off by default) ------------------
ROI_OVERRIDE_THRESHOLD = 0.05
ROI_OVERRIDES = (
    ("味・風味改善", 0.372),
    ("品質改善", 0.102),
    ("価格戦略", 0.163),
    ("配送・梱包改善", 0.08),
    ("カスタマーサービス改善", 0.06),
)

# --- FIXED VALUES: confidence analysis thresholds ----------------------------
HIGH_CONFIDENCE = 0.8
LOW_CONFIDENCE = 0.6

# --- FIXED VALUES: benchmark ladder, targets and texts -----------------------
PERCENTILE_LADDER = ((4.5, 90), (4.0, 75), (3.5, 50), (3.0, 25))
PERCENTILE_FLOOR = 10
TARGET_RATING_STEP = 0.5
TARGET_RATING_MAX = 5.0
TARGET_NEGATIVE_STEP = 0.05
TARGET_NEGATIVE_MIN = 0.05
TARGET_FIVE_STAR_STEP = 0.1
TARGET_FIVE_STAR_MAX = 0.8
STRENGTH_POSITIVE_SHARE = 0.7
STRENGTH_MEAN_RATING = 4.0
STRENGTH_FIVE_STAR_SHARE = 0.4
STRENGTH_TEXTS = ("高い顧客満足度", "良好な全体評価", "高評価レビューの多さ")
STRENGTH_DEFAULT = "分析中"
WEAKNESS_PERCENT = 15
WEAKNESS_SUFFIX = "の課題"
WEAKNESS_DEFAULT = "特定の課題なし"
OPPORTUNITY_TOP_SUFFIX = "の改善による大幅な向上"
OPPORTUNITY_NEGATIVE_SHARE = 0.15
OPPORTUNITY_NEGATIVE_TEXT = "ネガティブレビュー削減による評価向上"
OPPORTUNITY_DEFAULT = "継続的な品質向上"

# --- FIXED VALUES: KPI report -------------------------------------------------
KPI_NEGATIVE_PERCENT_STEP = 5
KPI_NEGATIVE_PERCENT_MIN = 5
# --- FIXED VALUES: texts of the business report --------------------------------
REPORT_TITLE = "レビュー分析 - ビジネス改善提案レポート"
REPORT_HEADINGS = {
    "summary": "エグゼクティブサマリー",
    "suggestions": "改善提案詳細（優先度順）",
    "roi": "ROI・投資対効果分析",
    "position": "競合比較・市場ポジション",
    "roadmap": "実装ロードマップ",
    "kpi": "成功指標・KPI",
}
REPORT_LISTS = {"strength": "強み:", "weakness": "弱み:", "opportunity": "改善機会:"}
REPORT_LABELS = {
    "generated": "生成日時: %s",
    "total": "総レビュー数: %s件",
    "negative": "ネガティブレビュー: %s件 (%.1f%%)",
    "mean": "平均評価: %.2f/5.0",
    "top": "最優先改善項目: %s",
    "suggestion": "%d. %s | 優先度スコア: %s | 影響レビュー数: %d件 | 推定コスト: $%s | ROI比: %.2f | 実装期間: %s | "
                  "リスクレベル: %s | 成功確率: %.0f%% | 具体的施策: %s",
    "roi": "%s: 投資額 $%s | 期待収益 $%s | ROI: %.1f%% | 回収期間: %.1fヶ月",
    "roi_total": "推定投資額: $%s | 期待リターン: $%s | 全体ROI: %.1f%%",
    "position": "現在のポジション: %d%%ile | 業界平均評価: %.2f | ネガティブ率: %.1f%%",
    "phase1": "フェーズ1 (最初の3ヶ月): %sの改善開始 | 予算: $%s",
    "phase2": "フェーズ2 (4-6ヶ月): %sの改善実施 | 予算: $%s",
    "kpi_rating": "平均評価: %.2f → %.2f",
    "kpi_negative": "ネガティブ率: %.1f%% → %.1f%%",
}
REPORT_ITEM = "• %s"
KPI_FIXED_LINES = ("5星評価率: +10%向上", "顧客満足度: +15%向上")

# --- FIXED VALUES: texts of the scoring report and of the dashboard summary -----
SCORING_REPORT_TITLE = "レビュー感情分析 - サマリーレポート"
SCORING_REPORT_HEADINGS = {
    "basic": "基本統計:",
    "sentiment": "感情分析結果:",
    "accuracy": "精度評価:",
    "negative": "ネガティブレビュー分析:",
    "problems": "主要問題:",
    "keywords": "キーワード分析:",
    "next": "次のステップ (Phase 3):",
}
SCORING_REPORT_LABELS = {
    "total": "総レビュー数: %s件",
    "completion": "分析完了率: %.1f%%",
    "count": "%s: %s件 (%.1f%%)",
    "confidence": "平均信頼度: %.3f",
    "accuracy": "全体精度: %.3f (%.1f%%)",
    "negative": "ネガティブレビュー: %s件 (%.1f%%)",
    "problem": "- %s: %d件 (%.1f%%)",
    "keywords": "%sの主要キーワード: %s",
}
SCORING_REPORT_NEXT = ("1. 改善提案エンジンの実装", "2. ROI算出システムの構築", "3. 競合比較機能の追加", "4. Webアプリケーション開発")
DASHBOARD_TITLE = "# レビュー分析 - サマリーレポート"
DASHBOARD_HEADINGS = {"overview": "## 分析概要", "sentiment": "## 感情分析結果"}
DASHBOARD_LABELS = {"total": "- 総レビュー数: %s件", "generated": "- 分析日時: %s", "count": "- %s: %d件 (%.1f%%)"}

# --- FIXED VALUES: column projections of the result files --------------------
SCORED_EXPORT_COLUMNS = (
    "product_id", "rating", "review_text", "sentiment_label", "bert_sentiment",
    "bert_confidence", "problem_category", "review_length",
)
SUGGESTION_EXPORT_COLUMNS = (
    "priority_rank", "category", "problem_type", "priority_score", "affected_reviews",
    "estimated_cost", "roi_estimate", "implementation_timeline", "risk_level",
    "success_probability", "top_suggestion",
)
ROI_DETAIL_COLUMNS = (
    "priority_rank", "category", "priority_score", "affected_reviews", "estimated_cost",
    "roi_estimate", "implementation_timeline", "risk_level", "success_probability",
)
DETAIL_ROWS = 20
SENTIMENT_DETAIL_COLUMNS = ("review_text", "rating", "bert_sentiment", "bert_confidence")
PHASE3_REQUIRED_COLUMNS = ("bert_sentiment", "bert_confidence", "problem_category", "rating")

# --- FIXED VALUES: chart parameters -------------------------------------------
CONFIDENCE_BINS = 50
DASHBOARD_CONFIDENCE_BINS = 30

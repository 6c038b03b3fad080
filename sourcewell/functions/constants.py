"""Fixed values that results depend on: word lists, thresholds, platform order."""

# fixed values: platforms in report order
PLATFORMS = ("bilibili", "douyin", "youtube", "xiaohongshu", "zhihu", "kuaishou", "weibo")

# fixed values: words that are no keywords
STOP_WORDS = (
    "the", "and", "for", "with", "review", "comparison", "long", "term", "experience", "what", "which", "how", "why", "is", "are",
    "一个", "这个", "那个", "如何", "怎么", "是否", "可以", "视频", "测评", "评测", "体验", "对比", "真实",
)

# fixed values: words of praise and of risk
POSITIVE_WORDS = ("推荐", "值得", "稳定", "好用", "优势", "提升", "优秀", "划算", "best", "worth", "good", "great", "recommend", "impressive")
RISK_WORDS = (
    "不值得", "缺点", "问题", "翻车", "发热", "续航", "售后", "贵", "差", "坑", "降级",
    "avoid", "bad", "problem", "issue", "overpriced", "worse", "risk",
)

# fixed values: words of counter-evidence and of negation
COUNTER_WORDS = (
    "缺点", "问题", "不足", "风险", "投诉", "吐槽", "避坑", "反对", "不推荐", "差",
    "issue", "problem", "risk", "complaint", "downside", "negative", "not recommend",
)
NEGATION_WORDS = ("不", "没有", "并非", "不是", "无", "not", "no", "never", "without", "false")

# fixed values: words of decision texts
DECISION_NEGATIVE_WORDS = (
    "差", "弱", "短板", "不行", "一般", "夹头", "闷", "热", "发热", "断连", "延迟", "贵",
    "problem", "weak", "worse", "bad", "hot", "warm", "expensive", "latency", "disconnect",
)
DECISION_POSITIVE_WORDS = POSITIVE_WORDS + ("强", "稳", "舒服", "舒适", "耐听", "清晰", "够用", "strong", "stable", "comfortable", "excellent", "clear", "better")
SCENARIO_WORDS = (
    "通勤", "飞机", "办公室", "游戏", "夜景", "户外", "夏天", "长时间", "会议",
    "airplane", "flight", "commute", "office", "gaming", "outdoor", "summer", "long",
)
DECISION_STOP_WORDS = STOP_WORDS + (
    "手机", "耳机", "笔记本", "平板", "相机", "产品", "推荐", "左右", "以内", "预算", "横评", "来源", "博主", "用户", "使用",
    "noise", "cancelling", "headphone", "headphones", "phone", "laptop", "tablet", "camera", "buy", "best", "recommend",
    "recommendation", "reviews", "versus", "source", "video", "use", "user",
)

# fixed values: words that tell the kind of a report
BUSINESS_WORDS = (
    "b端", "商家", "品牌方", "产品经理", "市场部", "运营", "品类", "类目", "赛道", "行业", "市场", "格局", "趋势", "机会", "竞品", "竞争",
    "用户画像", "需求洞察", "卖点", "定价", "渠道", "商业化", "category", "market", "landscape", "trend", "competitor", "competitive",
    "opportunity", "persona", "segment", "segmentation", "positioning", "pricing", "channel", "gtm",
)
BUSINESS_MARKERS = ("b端", "品牌方", "产品经理", "品类", "竞品", "category", "competitor")
SHOPPING_WORDS = (
    "值得", "买吗", "购买", "选择", "推荐", "预算", "价位", "以内", "左右", "买哪", "怎么选", "适合我",
    "should i", "worth", "buy", "best", "recommend", "recommendation", "under", "budget",
)
COMPARISON_WORDS = ("对比", "比较", "vs", "versus", "compare", "comparison")
DECISION_WORDS = ("值得", "买吗", "购买", "选择", "推荐", "买哪", "怎么选", "should i", "worth", "buy")
TREND_WORDS = ("趋势", "格局", "市场", "舆情", "landscape", "trend", "market")
EXPLAIN_WORDS = ("为什么", "如何", "怎么", "原因", "why", "how")
PRODUCT_WORDS = (
    "手机", "耳机", "笔记本", "平板", "相机", "咖啡机", "扫地机器人", "电视", "空调", "冰箱", "洗衣机", "汽车", "电动车", "护肤",
    "iphone", "ipad", "macbook", "headphone", "laptop", "tablet", "camera", "coffee machine", "robot vacuum", "tv", "car",
)
BUDGET_WORDS = ("以内", "左右", "预算", "价位", "元", "块", "under", "budget")
PREFERENCE_WORDS = ("好的", "好用", "适合", "更好", "best", "good", "better")

# fixed values: modalities that satisfy a search intent
INTENT_MODALITIES = {
    "review": ("speech", "subtitle", "text", "ocr"),
    "complaint": ("comment", "speech", "subtitle", "text"),
    "recommendation": ("speech", "subtitle", "text", "comment"),
    "comparison": ("speech", "subtitle", "text", "ocr"),
}

# fixed values: limits of one research run
BUDGET = {"sources": 50, "asr_minutes": 30, "llm_calls": 10, "llm_tokens": 50_000, "seconds": 300}
MIN_SOURCES, MIN_PLATFORMS = 3, 2

"""Limits, labels, word lists and patterns whose exact form decides the results."""

# ---- fixed values: whitespace -------------------------------------------------------------------
# The ECMAScript whitespace set, written for both java.util.regex and RE2 (body of a character class).
WS = r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
# One CJK ideograph (body of a character class).
CJK = r"\x{4e00}-\x{9fff}"

# ---- fixed values: note fields ------------------------------------------------------------------
UNTITLED_NOTE = "未命名素材"
UNTITLED_MARKDOWN = "未命名笔记"
DEFAULT_TOPIC = "Inbox"
LOCAL_SOURCE = "本地笔记"
TITLE_LIMIT = 200
CONTENT_LIMIT = 1_000_000
SUMMARY_LIMIT = 2_000
TOPIC_LIMIT = 100
SOURCE_LIMIT = 2_048
TAG_COUNT_LIMIT = 20
TAG_LENGTH_LIMIT = 50
RELATED_COUNT_LIMIT = 50
RELATED_LENGTH_LIMIT = 128
MERGED_TAG_LIMIT = 8

# ---- fixed values: question fields --------------------------------------------------------------
QUESTION_LIMIT = 2_000
HISTORY_LIMIT = 6
HISTORY_TEXT_LIMIT = 2_000
SCOPE_COUNT_LIMIT = 20
SCOPE_LENGTH_LIMIT = 100

# ---- fixed values: chunking, index, retrieval ---------------------------------------------------
CHUNK_TARGET = 700
CHUNK_MAX = 1_000
CHUNK_OVERLAP = 100
INDEX_VERSION = 1
EMBEDDING_DIM = 1_536
CHANNEL_LIMIT = 30
FUSION_K = 60
CONTEXT_CHUNKS = 8
CONTEXT_NOTES = 5
CONTEXT_CHUNKS_PER_NOTE = 2
QUOTE_LIMIT = 500
CITATION_LIMIT = 12
NOTE_QUOTE_LIMIT = 220
SUMMARY_PREVIEW = 96
TITLE_PREVIEW = 48
BASIC_SCAN = 20
BASIC_KEEP = 8
BASIC_ANSWER = 3
CONTEXT_NOTE_CHARS = 5_000
CONTEXT_TOTAL_CHARS = 20_000
RELATED_KEEP = 3
ANALYSIS_TAGS = 6
ANALYSIS_RELATED = 5
RETRY_DELAYS_S = (5, 30, 300)
MAX_ATTEMPTS = 4
LEASE_SECONDS = 300
INDEX_ERROR = "Indexing failed."
EDIT_QUIET_GAP = "700 milliseconds"

# ---- fixed values: request quotas (limit, window) -----------------------------------------------
QUOTAS = {
    "auth": (10, "15 minutes"),
    "ask": (30, "10 minutes"),
    "index_control": (150, "10 minutes"),
    "import": (10, "10 minutes"),
}

# ---- fixed values: answer texts -----------------------------------------------------------------
NO_EVIDENCE = "The current knowledge library does not contain enough evidence to answer this question."
NO_MODEL_ANSWER = "The selected knowledge is insufficient to answer."
BASIC_NO_ANSWER = "现有素材库里没有足够信息回答这个问题。可以先导入相关素材，或换一个更贴近当前素材的问题。"
UNTRUSTED_OPEN = "<UNTRUSTED_SOURCE_TEXT>\n"
UNTRUSTED_CLOSE = "\n</UNTRUSTED_SOURCE_TEXT>"
MISSING_SUMMARY = "这条素材还没有摘要。"
DEFAULT_REASONING = "已根据正文主题和现有素材做了轻量整理。"
FALLBACK_REASONING = "当前使用服务端 fallback：根据关键词重叠、标题和正文结构生成整理结果。"

# ---- fixed values: tag and topic rules (tag, words that trigger it), in output order ------------
TAG_RULES = (
    ("AI", ("AI",)),
    ("内容创作", ("创作", "写作")),
    ("本地优先", ("Markdown", "本地")),
    ("产品思考", ("产品",)),
    ("视频素材", ("视频", "字幕")),
    ("播客素材", ("播客", "音频")),
    ("素材复用", ("素材", "资料")),
)
DEFAULT_TAG = "待整理"
TOPIC_RULES = (("视频素材", "视频"), ("播客素材", "播客"))
FALLBACK_TOPIC = "素材库"

# ---- fixed values: generated documents ----------------------------------------------------------
OUTPUT_TITLES = {
    "outline": "文章大纲",
    "idea-card": "选题卡",
    "research-summary": "研究摘要",
    "wechat-draft": "公众号草稿",
    "xiaohongshu-note": "小红书笔记",
    "short-video-script": "短视频脚本",
}
OUTPUT_DEFAULT_TITLE = "内容输出"
OUTPUT_SOURCES_HEADING = "## 关键素材"
OUTPUT_CITATIONS_HEADING = "## 来源引用"

# ---- fixed values: import labels ----------------------------------------------------------------
EXTERNAL_PLATFORM = "外部来源"
PASTED_PLATFORM = "手动粘贴"
EXTERNAL_TAG = "外部素材"
EXTERNAL_TITLE = "外部内容"
EXTERNAL_ARTICLE = "外部文章"
FAILED_TITLE = "导入失败"
IMPORTED_TITLE = "外部导入"
UNKNOWN_SOURCE = "未知来源"
MANUAL_METHOD = "手动创建"
ARTICLE_METHOD = "公开网页正文提取"
WECHAT_METHOD = "公众号正文提取"
PENDING_METHOD = "链接卡片待补全"
FEED_METHOD = "RSS 节目信息提取"
WECHAT_PLATFORM = "微信公众号"
WECHAT_TITLE = "微信公众号文章"
WECHAT_TITLE_SUFFIX = "微信公众平台"
ARTICLE_MIN_CHARS = 80
WECHAT_MIN_CHARS = 40
WARN_SHORT_ARTICLE = "没有提取到足够正文，可能是动态渲染、登录后可见或反爬限制。"
WARN_SHORT_WECHAT = "公众号正文过短或未能正确加载。"
WARN_NO_WECHAT_BODY = "公众号页面没有暴露正文节点，可能需要登录或被平台限制。"
WARN_BAD_URL = "请输入有效链接。"
WARN_URL_CREDENTIALS = "链接不能包含账号凭据。"
WARN_URL_BLOCKED = "该链接地址不可访问。"
WARN_URL_PRIVATE = "该链接指向受保护的网络地址。"
WARN_NO_FEED_ITEM = "RSS 中没有找到节目单集。"
WARN_FEED_AUDIO = "已识别播客音频，但未配置转写 API Key。"
FEED_TITLE = "播客"
FEED_NO_DESCRIPTION = "暂无简介"
FEED_AUDIO_HINT = "> 配置转写模型后可自动转写该单集。"
AUTHOR_PREFIX = "作者："
SOURCE_TAGS = {"article": "文章", "video": "视频", "image": "图片", "podcast": "播客"}
SOURCE_TOPICS = {"article": "文章素材", "video": "视频素材", "image": "图片素材", "podcast": "播客素材"}

# (label, substrings of the url), first match wins
PLATFORM_RULES = (
    ("微信公众号", ("mp.weixin.qq.com",)),
    ("B站", ("bilibili.com", "b23.tv")),
    ("抖音", ("douyin.com", "iesdouyin.com")),
    ("小红书", ("xiaohongshu.com", "xhslink.com")),
    ("小宇宙", ("xiaoyuzhoufm.com",)),
    ("喜马拉雅", ("ximalaya.com",)),
    ("Apple Podcasts", ("podcasts.apple.com",)),
    ("YouTube", ("youtube.com", "youtu.be")),
)
# (label, words in a pasted text), case-insensitive, first match wins
PASTED_PLATFORM_RULES = (
    ("B站", r"bilibili\.com|b23\.tv"),
    ("抖音", r"douyin\.com|iesdouyin\.com"),
    ("小红书", r"xiaohongshu\.com|xhslink\.com"),
    ("播客", r"xiaoyuzhoufm\.com|ximalaya\.com|podcasts\.apple\.com|rss|feed|\.xml"),
    ("微信公众号", r"mp\.weixin\.qq\.com"),
)
PASTED_DEFAULT = "外部链接"
VIDEO_URL = r"bilibili\.com|b23\.tv|douyin\.com|iesdouyin\.com|xiaohongshu\.com|xhslink\.com|youtube\.com|youtu\.be|vimeo\.com"
PODCAST_URL = (
    r"(?i)xiaoyuzhoufm\.com|ximalaya\.com|podcasts\.apple\.com|podbean\.com|anchor\.fm|spotify\.com/.*episode|rss|feed|\.xml"
)
AUDIO_URL = r"(?i)\.(mp3|m4a|wav|aac|ogg|opus)(\?|#|$)"
SHORT_LINK_HOST = r"^(b23\.tv|v\.douyin\.com|www\.iesdouyin\.com|m\.weibo\.cn|xhslink\.com)$"
EMBEDDED_URL = r"""(?i)https?://[^\t\n\x0B\f\r \x{a0}\x{3000}"'<>，。]+"""
HTTP_URL = r"^https?://"
BLOCKED_HOSTS = ("localhost", "metadata.google.internal", "metadata.amazonaws.com")
CAPTION_LANGUAGES = ("zh-Hans", "zh-CN", "zh", "en")

# ---- fixed values: reliability classes ----------------------------------------------------------
REL_AUTO_CAPTION = "自动字幕"
REL_TRANSCRIPT = "自动转写"
REL_UPLOAD_IMAGE = "上传图片"
REL_UPLOAD_FILE = "上传文件"
REL_OCR = "图片 OCR"
REL_LINK = "原文链接"
REL_PASTED = "手动粘贴"
REL_CARD = "链接卡片"

# ---- fixed values: provenance block lines -------------------------------------------------------
TRACE_HEADING = "## 来源追踪"
TRACE_PLATFORM = "- 平台："
TRACE_ORIGIN = "- 原始来源："
TRACE_ORIGIN_LINK = "- 原始链接："
TRACE_METHOD = "- 导入方式："
TRACE_RELIABILITY = "- 来源可信度："
TRACE_TIME = "- 导入时间："
TRACE_PLAIN = "来源："
PENDING_LINES = (
    "你可以继续补充：",
    "",
    "- 上传本地音视频，尝试转写。",
    "- 粘贴字幕、视频文案或播客文稿。",
    "- 先保存这张链接卡片，之后再回来补充正文。",
)
PENDING_HEADING = "## 待补全素材"

# ---- fixed values: facets -----------------------------------------------------------------------
ALL_TAGS = "全部标签"

# ---- fixed values: podcast and video pages ------------------------------------------------------
PODCAST_PAGE_TITLE = "播客节目"
PODCAST_INTRO = "## 节目简介"
PODCAST_NO_INTRO = "未提取到节目简介。"
PODCAST_AUDIO_LINE = "音频链接："
PODCAST_AUDIO_NEXT = "> 配置转写模型后可自动提取播客全文。"
PODCAST_NO_AUDIO_NEXT = "> 未找到可直接访问的音频链接，可上传音频文件进行转写。"
AUDIO_TITLE = "播客音频"
AUDIO_METHOD = "音频直链保存"
AUDIO_BODY = "> 已识别音频链接。配置转写模型后可自动提取播客内容。"
AUDIO_WARNING = "未配置 AI Key，未执行语音转写。"
PODCAST_AUDIO_METHOD = "播客页面提取音频链接"
PODCAST_PAGE_METHOD = "播客页面信息提取"
PODCAST_WARN_AUDIO = "已找到音频链接，但未配置转写 API Key。"
PODCAST_WARN_NO_AUDIO = "未找到可直接访问的播客音频。"
PODCAST_DESCRIPTION_LIMIT = 2_000
VIDEO_TITLE_SUFFIX = " 视频"
VIDEO_REASON = "已识别视频链接，但没有找到可用字幕。"
VIDEO_DESCRIPTION = "你可以上传本地音频/视频，或手动粘贴字幕后补全这条素材。"
VIDEO_WARNING = "未找到字幕。"
VIDEO_CAPTION_METHOD = "公开视频字幕提取"
VIDEO_CAPTION_WARNING = "已优先使用视频字幕/自动字幕生成素材。"
VIDEO_UNKNOWN_AUTHOR = "未知"

# ---- fixed values: html to Markdown steps (pattern, replacement), applied in order ---------------
# Patterns are written for both java.util.regex and RE2; \1 and \2 name groups.
HTML_NOISE = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<(?:script|style|iframe|svg|nav|noscript|template)\b.*?</(?:script|style|iframe|svg|nav|noscript|template)\s*>", ""),
    (r"(?is)<(?:wx-open-launch-app|mp-common-profile)\b.*?</(?:wx-open-launch-app|mp-common-profile)\s*>", ""),
    (r"(?is)<[a-z][a-z0-9]*\s[^>]*(?:\shidden|display:\s*none)[^>]*>[^<]*</[a-z][a-z0-9]*\s*>", ""),
)
HTML_TO_MARKDOWN = (
    (r"[\t\n\f\r ]+", " "),
    (r"(?i)<h1(?:\s[^>]*)?>", "\n\n# "),
    (r"(?i)<h2(?:\s[^>]*)?>", "\n\n## "),
    (r"(?i)<h3(?:\s[^>]*)?>", "\n\n### "),
    (r"(?i)<h4(?:\s[^>]*)?>", "\n\n#### "),
    (r"(?i)<h5(?:\s[^>]*)?>", "\n\n##### "),
    (r"(?i)<h6(?:\s[^>]*)?>", "\n\n###### "),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)<li(?:\s[^>]*)?>", "\n- "),
    (r"(?i)</?(?:p|h[1-6]|ul|ol|div|section|article|blockquote|table|tr|pre|figure)(?:\s[^>]*)?>", "\n\n"),
    (r"(?i)<(?:b|strong)>([^<]+)</(?:b|strong)>", r"**\1**"),
    (r"(?i)<(?:i|em)>([^<]+)</(?:i|em)>", r"_\1_"),
    (r'(?i)<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', r"[\2](\1)"),
    (r'(?i)<img\s[^>]*?(?:data-)?src="([^"]*)"[^>]*>', r"![](\1)"),
    (r"<[^>]*>", ""),
    (r"&nbsp;|&#160;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;|&#34;", '"'),
    (r"&#39;|&apos;", "'"),
    (r"&amp;", "&"),
    (r" *\n *", "\n"),
    (r"\n{3,}", "\n\n"),
)

# Pieces of the texts that answers, cards and imports consist of.
BASIC_LINE = ("从「", "」看：")
RELATED_REASON = ("和「", "」共享主题词或使用场景。")
FACT_PLATFORM = "- 平台："
FACT_AUTHOR = "- 作者："
FACT_LINK = "- 链接："
FACT_PUBLISHED = "- 发布时间："
ARTICLE_FACTS = "## 文章信息"
ARTICLE_BODY = "## 正文"
VIDEO_FACTS = "## 视频信息"
VIDEO_BODY = "## 字幕文本"
METHOD_AUTO_CAPTION = "自动字幕"
METHOD_TRANSCRIPT = "转写"
METHOD_UPLOAD = "上传"
METHOD_OCR = "OCR"

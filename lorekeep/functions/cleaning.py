"""Cleaning, core-message test, importance and ordered redaction of message texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions.text import strip

# Words that mark a technical message.
KEYWORDS = (
    "```", "error", "Error", "ERROR", "Exception", "exception",
    "failed", "Failed", "FAILED", "报错", "问题", "修改", "添加",
    "创建", "删除", "重构", "优化", "bug", "Bug", "BUG", "fix",
    "Fix", "实现", "开发", "部署", "配置", "接口", "数据库",
    "import", "class ", "def ", "function", "return",
    "API", "api", "请求", "响应", "参数", "返回值",
    "测试", "test", "Test", "调试", "debug", "Debug",
    "性能", "缓存", "cache", "Cache",
    "安全", "security", "权限", "认证", "授权",
    "日志", "log", "监控", "monitor",
    "依赖", "dependency", "版本", "version",
    "架构", "设计", "模式", "pattern",
    "异常", "处理", "handler", "回调", "callback",
    "异步", "async", "同步", "sync",
    "事务", "transaction", "锁", "lock",
    "队列", "queue", "消息", "message",
    "序列化", "serialize", "解析", "parse",
    "查询", "query", "更新", "update", "插入", "insert",
    "重试", "retry", "超时", "timeout",
    "上传", "upload", "下载", "download",
    "迁移", "migrate", "升级", "upgrade",
    "兼容", "compatible", "适配", "adapt",
    "插件", "plugin", "钩子", "hook", "事件", "event",
    "发布", "publish", "订阅", "subscribe",
    "告警", "alert", "崩溃", "crash", "死锁", "deadlock",
)

# Answers that say nothing.
TRIVIAL = (
    r"(?iu)^(好的|ok|嗯|继续|是的|对|明白|收到|谢谢|thanks|got it|sure|yes|no|"
    r"好|行|可以|没问题|了解|知道了|看看|试试|帮我|请|嗯嗯|okay)[\s。！!.\?？]*$"
)

# Kinds of secrets in the order they are replaced; the pattern, and whether a group before the value stays.
SECRETS = (
    ("private_key_block", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----[\s\S]+?-----END (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", False),
    ("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", False),
    ("aws_secret_key", r"(?i)((?:aws[_\-]?secret[_\-]?access[_\-]?key|secret[_\-]?key)\s*[:=]\s*['\"]?)[A-Za-z0-9/+=]{40}['\"]?", True),
    ("openai_token", r"\bsk-(?:ant-)?[A-Za-z0-9_\-]{20,}\b", False),
    ("slack_token", r"\bxox[baprso]-[A-Za-z0-9\-]{10,}\b", False),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", False),
    ("jwt", r"\beyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{6,}\b", False),
    ("jdbc_password", r"(?i)((?:jdbc:|mysql://|postgres(?:ql)?://|mongodb(?:\+srv)?://)[^\s]*?password=)[^\s&;'\"]+", True),
    ("generic_secret_kv", r"(?i)(\b(?:password|passwd|pwd|secret|api[_\-]?key|access[_\-]?token|auth[_\-]?token)\s*[:=]\s*['\"]?)[^\s'\"]{6,}['\"]?", True),
)

#: Characters from which a tool result or code block is left out.
LONG = 5000


def _noise(least: int) -> tuple[tuple[str, str], ...]:
    # What is cut out of messages, in order, and the note in its place.
    return (
        (rf"<tool_result>[\s\S]{{{least},}}?</tool_result>", "[工具执行结果已省略]"),
        (rf"<tool_output>[\s\S]{{{least},}}?</tool_output>", "[工具执行结果已省略]"),
        (r"data:image/[^;]+;base64,[A-Za-z0-9+/=]+", "[图片数据已省略]"),
        (rf"```[\s\S]{{{least},}}?```", "[长代码块已省略]"),
        (r"(?:%[0-9A-Fa-f]{2}){50,}", "[编码数据已省略]"),
    )


def clean(text: Column, least: int = LONG) -> Column:
    """Long tool results, images, long code and encoded data left out, blank lines folded, ends stripped. Null: empty."""
    out = F.coalesce(text, F.lit(""))
    for pattern, note in _noise(least):
        out = F.regexp_replace(out, pattern, note)
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def importance(text: Column) -> Column:
    """How many of the technical words a text holds."""
    return F.size(F.filter(F.array(*(F.lit(k) for k in KEYWORDS)), lambda k: F.contains(text, k)))


def is_core(text: Column) -> Column:
    """Whether a user message is more than small talk."""
    bare = strip(text)
    return (bare != "") & ~bare.rlike(TRIVIAL) & ((F.length(bare) >= 50) | (importance(bare) > 0))


def redacted(text: Column) -> tuple[Column, dict[str, Column]]:
    """The text with secrets replaced, and the hits of each kind, counted on the text as its turn finds it."""
    out, counts = F.coalesce(text, F.lit("")), {}
    for kind, pattern, keep in SECRETS:
        counts[kind] = F.regexp_count(out, F.lit(pattern))
        out = F.regexp_replace(out, pattern, ("$1" if keep else "") + f"<REDACTED:{kind}>")
    return out, counts

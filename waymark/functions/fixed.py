"""Rule defaults, labels and names that results must reproduce exactly."""

# Rule defaults, by section of the rule file.
DEFAULT_RULES = {
    "default_timeout": 3.0,
    "max_body_bytes": 524288,
    "network": {
        "user_agent": "Mozilla/5.0 (compatible; waymark-probe)",
        "retry_attempts": 2,
        "retry_backoff_seconds": 0.6,
        "verify_tls": False,
        "use_env_proxy": False,
    },
    "http": {
        "https_port_hints": [443, 8443, 9443, 10443],
        "html_content_types": ["text/html", "application/xhtml+xml"],
        "key_paths": ["/robots.txt", "/favicon.ico", "/sitemap.xml", "/.well-known/"],
    },
    "registrable_domain": {
        "multi_level_suffixes": [
            "ac.cn", "co.jp", "co.kr", "co.uk", "com.au", "com.cn", "com.hk", "com.sg", "edu.cn", "gov.cn", "net.cn", "org.cn",
        ],
    },
    "noise": {
        "small_gateway_statuses": [502, 503, 504],
        "small_gateway_body_length": 2048,
        "cdn_servers": ["cloudflare", "cloudfront", "akamai"],
        "cdn_statuses": [403, 503],
        "cdn_body_keywords": ["access denied", "attention required", "cloudflare ray id"],
        "title_patterns": [
            r"\b503 service temporarily unavailable\b",
            r"\bserver unavailable\b",
            r"\bbad gateway\b",
            r"\b504 gateway time-?out\b",
            r"\berror 502\b",
            r"\battention required!?\b",
            r"\bweb application firewall\b",
            r"\bwaf\b",
        ],
        "body_patterns": [
            "web application firewall",
            "request blocked",
            "security check",
            "your request has been blocked",
            "knownsec",
            "safeline",
            "forbidden by waf",
            "cloudflare ray id",
            "temporarily unavailable",
            "error 1020.*access denied|access denied.*error 1020",
            "direct ip access not allowed.*error code:? 1003|error code:? 1003.*direct ip access not allowed",
            "just a moment.*cloudflare ray id|cloudflare ray id.*just a moment",
            "the request could not be satisfied.*generated by cloudfront|generated by cloudfront.*the request could not be satisfied",
            "access denied.*reference #|reference #.*access denied",
            "guru mediation",
            "error 54113",
            r"request unsuccessful\. incapsula incident id",
            "sucuri website firewall - access denied",
            r"the requested url was rejected\. please consult with your administrator",
            r"请求错误\s*\|\s*云防护",
            "当前访问是scdn节点ip地址.*防护节点.*源站服务器",
            "当前是节点ip地址.*防护节点.*源站服务器",
        ],
        "response_patterns": [
            '<font id="description" style="font-family:MicrosoftYaHei;font-size:1.875rem;color:#999999;word-wrap:break-word;">'
            "所请求的页面不存在或已被删除！</font>",
        ],
        "default_page_patterns": [
            "welcome to nginx",
            "test page for the nginx http server",
            "apache2 ubuntu default page",
            "apache http server test page",
            "iis windows server",
            "welcome to tomcat",
            "tomcat default",
        ],
    },
    "low_information": {"body_length_threshold": 512, "min_non_icon_resources": 2},
    "response_shells": {
        "maintenance_title_patterns": ["网站维护更新中", "敬请期待", "升级维护", "系统维护中"],
        "maintenance_body_patterns": ["网站维护更新中", "敬请期待", "升级维护", "系统维护中"],
        "deny_statuses": [401, 403],
        "deny_text_patterns": ["access denied", "forbidden"],
        "auth_content_types": ["application/json"],
        "auth_text_patterns": ["暂未登录", "token已经过期", "not authenticated", "unauthorized"],
    },
    "auth_shell_patterns": [
        r"\b(single sign-on|sso|oauth|cas)\b",
        "(统一登录|统一身份认证|身份认证|单点登录)",
        r"\b(login|sign in|signin|authentication|auth)\b",
    ],
    "business_text_pattern": r"[A-Za-z0-9一-鿿]{4,}",
}

# Group types.
HTTP_TO_HTTPS = "标准HTTP跳转HTTPS"
SAME_HOST = "同hostname多端口等价"
SAME_DOMAIN = "同主域子域等价"
CROSS_DOMAIN = "同IP跨主域强等价"
SAME_HOST_SHELL = "同hostname多端口非业务响应页收敛"
SUBDOMAIN_SHELL = "同端口子域非业务响应页收敛"

# Reasons for staying independent, in the order they are tested.
ALONE_PROBE_FAILED = "探测失败，无法证明可合并"
ALONE_IP = "IP直连入口默认不自动合并"
ALONE_LOW_INFORMATION = "页面信息量不足，不参与跨站点自动收敛"
ALONE_AUTH = "疑似统一认证响应页，不参与跨站点自动收敛"
ALONE_WEAK = "五维特征不足，默认保留"
ALONE_DEFAULT = "默认保留为独立站点"

# Noise reasons.
NOISE_GATEWAY = "命中小体积网关错误页"
NOISE_TITLE = "命中错误页/WAF标题特征"
NOISE_BODY = "命中错误页/WAF正文特征"
NOISE_RESPONSE = "命中错误页/WAF原始响应特征"
NOISE_CDN = "命中CDN/WAF拦截页"
NOISE_MAINTENANCE = "命中明确维护页"
NOISE_DENY = "同hostname多端口统一拒绝访问响应页"

# Merge reasons.
WHY_HTTP_TO_HTTPS = "HTTP 入口存在明确 3xx 跳转，且落点为同 hostname 的 HTTPS 入口"
WHY_SAME_HOST = "同一 hostname 下五个判定维度全部一致，可视为同一站点"
WHY_SAME_HOST_REDIRECT = "同一 hostname 下五个判定维度全部一致，且包含标准 HTTP -> HTTPS 跳转成员"
WHY_SAME_DOMAIN = "同一主域名下不同子域的五个判定维度全部一致，可视为同一站点"
WHY_CROSS_DOMAIN = "不同主域名入口解析到同一 IP，且五个判定维度与正文指纹全部一致，可视为同一站点"
WHY_SAME_HOST_SHELL = "同一 hostname 下不同端口返回完全一致的低信息量响应页或统一认证响应页，可收敛为一个代表入口"
WHY_SUBDOMAIN_SHELL = (
    "同主域不同子域在相同端口返回完全一致的低信息量响应页、统一认证响应页或统一拒绝访问响应页，且解析 IP 一致，可收敛为一个代表入口"
)

# Response shells and their reasons.
SHELL_REASONS = {
    "maintenance_shell": NOISE_MAINTENANCE,
    "auth_api_shell": "命中统一认证/API未登录响应页",
    "deny_shell": "命中统一拒绝访问响应页",
    "low_information_shell": "命中低信息量响应页",
}

# Failure categories with the substrings that decide them, first match wins.
FAILURES = [
    ("SSL证书校验失败", ["certificate verify failed", "hostname mismatch", "ssl"]),
    ("代理连接失败", ["proxyerror", "unable to connect to proxy", "proxy"]),
    ("请求超时", ["timed out", "read timeout", "connect timeout"]),
    ("DNS解析失败", ["nodename nor servname", "name or service not known", "temporary failure in name resolution"]),
    ("连接被拒绝", ["connection refused"]),
    ("远端直接关闭连接", ["remote end closed connection without response"]),
    ("连接被重置或中断", ["connection reset", "connection aborted"]),
]
FAILURE_OTHER = "其他请求失败"
FINAL_TLS_ERRORS = [
    "certificate verify failed", "hostname mismatch", "self-signed certificate", "unable to get local issuer certificate",
    "wrong version number", "tlsv1 alert", "sslv3 alert",
]

# Payload fields that carry meaning, and the structured content types.
SEMANTIC_FIELDS = [
    "code", "message", "msg", "error", "errors", "success", "resource", "path", "status", "reason", "type", "detail", "details",
    "data", "errorcode", "errormessage", "errordescription",
]
XML_TYPES = ["application/xml", "text/xml"]
JSON_TYPES = ["application/json"]

# Summary counters.
COUNT_INPUT, COUNT_FAILED, COUNT_NOISE = "输入站点数", "探测失败数", "噪音站点数"
COUNT_GROUPS, COUNT_MEMBERS, COUNT_ALONE = "可合并站点组数", "可合并站点成员数", "独立站点数"
COUNT_WORKERS, SECONDS, DURATION = "使用并发数", "任务耗时秒", "任务耗时"

# Texts of the report and of durations.
HOURS, MINUTES, SECONDS_MS, MS = "{}小时{}分{}秒", "{}分{}秒", "{}.{:03d}秒", "{}毫秒"
NONE, COMMA, SEMICOLON, SHORTENED = "无", "，", "；", " ...（其余 {} 个省略）"
HEAD_SUMMARY, HEAD_FAILURES, HEAD_NOISE = "结果概要", "失败原因概要", "噪音站点示例"
HEAD_GROUPS, HEAD_ALONE = "可合并站点组概要", "独立站点示例"
MORE_FAILURES, MORE_NOISE = "- 其余 {} 类失败原因省略", "- 其余 {} 个噪音站点省略"
MORE_GROUPS, MORE_ALONE = "- 其余 {} 个合并组省略", "- 其余 {} 个独立站点省略"
FAILURE_LINE, SAMPLE_LINE = "- {}: {} 个", "  示例: {}"
GROUP_LABELS = ["类型", "代表站点", "成员数", "成员示例", "原因"]
NO_SITES, BAD_INPUT, NO_RULES = "输入文件中没有可用站点", "加载输入失败: {}", "规则文件不存在: {}"
WRITTEN, RULES_AT = "完整 JSON 结果已写入: {}", "规则文件: {}"

# Parts of a page that carry no text: removed before tags are.
HIDDEN_PATTERN, TAG_PATTERN = r"(?is)<(script|style).*?>.*?</\1>", r"(?s)<[^>]+>"

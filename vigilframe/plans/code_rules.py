"""Rules over source code, as scanners take them."""

from vigilframe.functions.text import CRITICAL, HIGH, MEDIUM
from vigilframe.plans.rules import Rule

# Category, name, pattern, risk; the categories that are reported under a second name; values that are no credentials.
_SQL = r"(?:cursor\.execute|\.execute|\.executemany|\.query|\.raw)\s*\(\s*"
_CODE = (
    ("sql_injection", "sql_fstring", rf"(?i){_SQL}f[\"']", CRITICAL),
    ("sql_injection", "sql_format", rf"(?i){_SQL}[\"'].*?[\"']\s*\.format\s*\(", CRITICAL),
    ("sql_injection", "sql_percent", rf"(?i){_SQL}[\"'].*?%s.*?[\"']\s*%\s*", HIGH),
    ("sql_injection", "sql_concat", r"(?i)(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM|DROP|CREATE|ALTER)\s+.*?[\"']\s*\+\s*\w", HIGH),
    ("sql_injection", "sql_user_input", r"(?i)(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\s+.*?(?:[\"']?\s*\+\s*(?:req|request|user|input|params|args|data)\b|\{\s*(?:req|request|user|input|params|args|data)\b)", HIGH),
    ("sql_injection", "sql_fstring_standalone", r"(?i)f[\"'](?=.*(?:SELECT|INSERT|UPDATE|DELETE|DROP)\s).*?\{.*?\}.*?[\"']", HIGH),
    ("command_injection", "os_system", r"(?i)os\.system\s*\(", CRITICAL),
    ("command_injection", "os_popen", r"(?i)os\.popen\s*\(", CRITICAL),
    ("command_injection", "subprocess_shell", r"(?is)subprocess\.(?:call|run|Popen|check_output|check_call)\s*\(.*?shell\s*=\s*True", HIGH),
    ("command_injection", "os_system_interpolation", r"(?i)os\.(?:system|popen)\s*\(\s*(?:f[\"']|[\"'].*?\+|.*?\.format|.*?%\s)", CRITICAL),
    ("command_injection", "js_exec_user_input", r"(?i)(?:child_process\.exec|execSync|eval)\s*\(.*?(?:req\.|request\.|params\.|query\.|body\.|input|args)", CRITICAL),
    ("path_traversal", "open_fstring", r"(?i)open\s*\(\s*f[\"'].*?\{.*?(?:path|file|filename|name|dir|folder|upload|user|input|param).*?\}", HIGH),
    ("path_traversal", "open_concat", r"(?i)open\s*\(\s*(?:\w+\s*\+\s*[\"']|[\"'].*?[\"']\s*\+\s*\w)", MEDIUM),
    ("path_traversal", "dotdot_path", r"(?i)(?:open|Path)\s*\(\s*.*?\.\.[\\/]", HIGH),
    ("path_traversal", "open_user_input", r"(?i)open\s*\(\s*(?:f[\"']|.*?\+|.*?\.format|.*?os\.path\.join\s*\().*?(?:req|request|user|input|params|filename|path|file_path|upload)\b", HIGH),
    ("path_traversal", "send_file_user_input", r"(?i)(?:send_file|send_from_directory)\s*\(.*?(?:request|user|input|params|filename)\b", MEDIUM),
    ("unsafe_deserialization", "pickle_load", r"(?i)pickle\.loads?\s*\(", HIGH),
    ("unsafe_deserialization", "yaml_unsafe_load", r"(?i)yaml\.(?:load|unsafe_load)\s*\((?!.*Loader\s*=\s*(?:yaml\.)?SafeLoader)", HIGH),
    ("unsafe_deserialization", "eval_call", r"(?i)\beval\s*\(\s*(?!['\"][^'\"]*['\"]?\s*\))", HIGH),
    ("unsafe_deserialization", "exec_call", r"(?i)\bexec\s*\(\s*(?!['\"][^'\"]*['\"]?\s*\))", HIGH),
    ("unsafe_deserialization", "marshal_load", r"(?i)marshal\.loads?\s*\(", HIGH),
    ("unsafe_deserialization", "shelve_open", r"(?i)shelve\.open\s*\(", MEDIUM),
    ("hardcoded_credential", "hardcoded_password", r"(?i)(?:password|passwd|pwd|pass_?word)\s*=\s*[\"'](?!(?:\s*[\"']|.*os\.environ|.*os\.getenv|.*ENV\[|.*\$\{))[^\"']{8,}[\"']", HIGH),
    ("hardcoded_credential", "hardcoded_secret", r"(?i)(?:secret|secret_key|api_key|apikey|api_secret|api_token|access_key|access_token|auth_token|private_key|client_secret)\s*=\s*[\"'](?!(?:\s*[\"']|.*os\.environ|.*os\.getenv|.*ENV\[|.*\$\{))[^\"']{8,}[\"']", HIGH),
    ("hardcoded_credential", "hardcoded_aws_key", r"(?:AKIA|ASIA)[A-Z0-9]{16}", CRITICAL),
    ("hardcoded_credential", "hardcoded_credential_eol", r"(?im)(?:password|passwd|pwd|secret|api_key|apikey|api_secret|access_token|auth_token|private_key|secret_key)\s*=\s*[\"][^\"]{8,}[\"]\s*$", CRITICAL),
    ("xss_vulnerability", "render_template_string", r"(?i)render_template_string\s*\(.*?(?:request|user|input|data|param|query|body)\b", HIGH),
    ("xss_vulnerability", "render_template_string_interpolation", r"(?i)render_template_string\s*\(\s*(?:f[\"']|[\"'].*?[\"']\s*\.format\s*\(|[\"'].*?%s)", HIGH),
    ("xss_vulnerability", "markup_user_data", r"(?i)Markup\s*\(\s*(?:f[\"']|.*?(?:request|user|input|data|param|query|body)\b|[\"'].*?[\"']\s*\.format\s*\()", HIGH),
    ("xss_vulnerability", "jinja_safe_filter", r"\{\{.*?\|\s*safe\s*\}\}", HIGH),
    ("xss_vulnerability", "innerhtml_assignment", r"(?i)\.innerHTML\s*=\s*(?![\"']\s*$).*?(?:request|user|input|param|query|data|variable)\b", HIGH),
    ("xss_vulnerability", "document_write", r"(?i)document\.write\s*\((?!['\"][^'\"]*['\"]\s*\))", MEDIUM),
    ("insecure_http", "http_url", r"(?i)(?:requests\.(?:get|post|put|delete|patch|head|options)|urllib\.request\.urlopen|urlopen|http\.client\.HTTPConnection)\s*\(\s*[\"']http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\])", MEDIUM),
    ("insecure_http", "http_url_assignment", r"(?i)(?:url|endpoint|api_url|base_url|server_url|host)\s*=\s*[\"']http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\])[^\"']+[\"']", MEDIUM),
    ("insecure_http", "verify_false", r"(?is)(?:requests\.(?:get|post|put|delete|patch|head|options|request|Session)|\.request|\.get|\.post)\s*\(.*?verify\s*=\s*False", HIGH),
    ("insecure_crypto", "weak_hash", r"(?i)(?:hashlib\.)?(?:md5|sha1)\s*\(", MEDIUM),
    ("insecure_crypto", "aes_ecb", r"(?i)AES\.new\s*\(.*?MODE_ECB", HIGH),
    ("insecure_crypto", "des_usage", r"(?i)DES\b.*?\.new\s*\(", HIGH),
    ("ssrf", "ssrf_user_url", r"(?i)(?:requests\.(?:get|post|put|delete|patch|head)|urllib\.request\.urlopen|http\.client\.HTTP|fetch\s*\(|axios\.(?:get|post))\s*\(.*?(?:req\.|request\.|params\.|query\.|body\.|user_?input|url_param)\b", HIGH),
)
ALIASES = {"unsafe_deserialization": "insecure_deserialization", "hardcoded_credential": "hardcoded_secret", "xss_vulnerability": "xss"}
NO_CREDENTIALS = (
    "password", "your_password", "your_password_here", "changeme", "example", "your_api_key", "your_secret", "your_token", "xxx", "todo", "placeholder", "test", "testing",
    "dummy", "fake", "mock", "replace_me", "insert_key_here", "password123", "secret123", "change_me",
)

CODE = tuple(Rule("code_scanner", name, pattern, risk) for _, name, pattern, risk in _CODE)
CATEGORY = {name: category for category, name, _, _ in _CODE}

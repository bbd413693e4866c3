"""What extraction looks for: regular expressions by language, as data.

A rule's first group is the name. ``prefix`` + name is the node's id; ``edge`` joins the file to it, or it to the file when
``reverse``. Rules of one ``scope`` see a name once in a file: the one of higher priority, then the earlier.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    name: str
    language: str
    pattern: str
    prefix: str
    kind: str
    edge: str
    priority: int = 50
    confidence: float = 1.0
    scope: str = ""  #: the rule's own name if empty
    reverse: bool = False
    several: bool = False  #: the group is a list in code, of which each word is a name
    check: str = ""  #: "env" or "table": names must pass that test


Q, NQ = "[\"'`]", "[^\"'`\\n]+"


def _env(name, language, pattern, priority=50, **more):
    return Rule(name, language, pattern, "env:", "env_var", "reads", priority, scope=f"{language}-env", **{"check": "env" if language in ("python", "javascript") else "", **more})


def _table(name, pattern, edge, priority=50, prefix="data:"):
    return Rule(name, "python", pattern, prefix, "data_asset", edge, priority, scope=f"table-{edge}", check="table")


_READ = r"\.read(?:Stream)?(?:\s*\\?\s*\.\w+\((?:[^()]|\([^()]*\))*\))*?\s*\\?\s*"
_WRITE = r"\.write(?:Stream)?(?:\s*\\?\s*\.\w+\((?:[^()]|\([^()]*\))*\))*?\s*\\?\s*"
_SQL_NAME = r"([A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*){0,2})"

RULES = [
    # Python: variables
    _env("py_getenv", "python", rf"\bos\s*\.\s*(?:getenv|environ\s*\.\s*(?:get|pop|setdefault))\s*\(\s*{Q}({NQ}){Q}", 100),
    _env("py_environ", "python", rf"\bos\s*\.\s*environ\s*\[\s*{Q}({NQ}){Q}", 100),
    _env("py_bare_getenv", "python", rf"(?<![\w.])(?:getenv|environ\s*\.\s*(?:get|pop|setdefault))\s*\(\s*{Q}({NQ}){Q}", 100),
    _env("py_bare_environ", "python", rf"(?<![\w.])environ\s*\[\s*{Q}({NQ}){Q}", 100),
    _env("py_in_environ", "python", rf"{Q}(\w+){Q}\s+(?:not\s+)?in\s+(?:os\s*\.\s*)?environ\b", 95),
    _env("py_field", "python", rf"\bField\s*\((?:[^()]|\([^()]*\))*?\b(?:env|validation_alias)\s*=\s*{Q}(\w+){Q}", 90),
    _env("py_envvar", "python", rf"\benvvar\s*=\s*{Q}(\w+){Q}", 80),
    _env("py_envvars", "python", r"\benvvar\s*=\s*[\[(]([^\])]*)[\])]", 80, several=True),
    _env("py_env_object", "python", rf"(?<![\w.])env(?:\.(?:str|bool|int|float|list|tuple|dict|json|url|db|cache|path|date|datetime|timedelta|uuid|log_level|decimal|bytes))?\s*\(\s*{Q}([A-Z]\w*){Q}", 60),
    _env("py_variable", "python", rf"\bVariable\s*\.\s*(?:get|setdefault)\s*\(\s*{Q}({NQ}){Q}", 50, check=""),
    _env("py_heuristic", "python", r"(?m)^([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*_(?:URL|URI|HOST|PORT|KEY|TOKEN|SECRET|PASSWORD|ENDPOINT|BUCKET|DSN))\s*(?::\s*\w+\s*)?=(?=.*\b(?:env|config|settings|environ|getenv)\b)", 10, confidence=0.7),
    # Python: imports and definitions
    Rule("py_from", "python", r"(?m)^[ \t]*from\s+([\w.]+)\s+import\b", "py:", "code_file", "imports", scope="py-import"),
    Rule("py_import", "python", r"(?m)^[ \t]*import\s+([\w.]+)", "py:", "code_file", "imports", scope="py-import"),
    Rule("py_definition", "python", r"(?m)^(?:async\s+)?(?:def|class)\s+(\w+)", "entity:{path}:", "code_entity", "contains"),
    # JavaScript and TypeScript
    _env("js_dot", "javascript", r"\bprocess\s*\.\s*env\s*\??\.\s*([A-Za-z_$][\w$]*)"),
    _env("js_index", "javascript", rf"\bprocess\s*\.\s*env\s*\[\s*{Q}(\w+){Q}"),
    _env("js_meta", "javascript", r"\bimport\s*\.\s*meta\s*\.\s*env\s*\??\.\s*([A-Za-z_]\w*)"),
    _env("js_destructured", "javascript", r"\{([^{}]*)\}\s*=\s*(?:process|import\s*\.\s*meta)\s*\.\s*env\b", several=True),
    Rule("js_import", "javascript", rf"\b(?:import|export)\s+(?:type\s+)?[\w*{{}}\s,$]+?\bfrom\s*{Q}({NQ}){Q}", "js:", "code_file", "imports", scope="js-import"),
    Rule("js_bare_import", "javascript", rf"(?m)^[ \t]*import\s*{Q}({NQ}){Q}", "js:", "code_file", "imports", scope="js-import"),
    Rule("js_require", "javascript", rf"\b(?:require|import)\s*\(\s*{Q}({NQ}){Q}\s*\)", "js:", "code_file", "imports", scope="js-import"),
    Rule("js_definition", "javascript", r"(?m)^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?|class|interface|enum)\s+([A-Za-z_$][\w$]*)", "entity:{path}:", "code_entity", "contains", scope="js-definition"),
    Rule("js_arrow", "javascript", r"(?m)^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=\n]+)?=>", "entity:{path}:", "code_entity", "contains", scope="js-definition"),
    Rule("next_page", "javascript", r"\bexport\s+(?:async\s+)?function\s+(getServerSideProps|getStaticProps|getStaticPaths)\b", "entity:{path}:", "code_entity", "contains"),
    Rule("js_fetch", "javascript", rf"\b(?:fetch|axios(?:\.\w+)?)\s*\(\s*{Q}https?://([\w.-]+)", "external:", "unknown", "calls"),
    # Go
    _env("go_env", "go", r"\bos\s*\.\s*(?:Getenv|LookupEnv|Setenv)\s*\(\s*\"([^\"\s]+)\""),
    _env("go_viper", "go", r"\bviper\s*\.\s*(?:BindEnv|MustBindEnv)\s*\((?:\s*\"[^\"]*\"\s*,)?\s*\"([^\"\s]+)\""),
    _env("go_tag", "go", r"`[^`]*\b(?:env|envconfig)\s*:\s*\"([A-Za-z_]\w*)[^\"]*\"[^`]*`"),
    Rule("go_import", "go", r"(?m)^[ \t]*import\s+(?:[\w.]+\s+)?\"([^\"]+)\"", "go:", "code_file", "imports", scope="go-import"),
    Rule("go_imports", "go", r"(?m)^[ \t]*import\s*\(([^)]*)\)", "go:", "code_file", "imports", scope="go-import", several=True),
    Rule("go_function", "go", r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]", "entity:{path}:", "code_entity", "contains", scope="go-definition"),
    Rule("go_type", "go", r"(?m)^type\s+(\w+)\s+(?:struct|interface|\w)", "entity:{path}:", "code_entity", "contains", scope="go-definition"),
    # Java
    _env("java_env", "java", r"\bSystem\s*\.\s*(?:getenv|getProperty)\s*\(\s*\"([^\"\s]+)\""),
    _env("java_value", "java", r"@Value\s*\(\s*(?:value\s*=\s*)?\"\$\{([^}:\s]+)"),
    _env("java_property", "java", r"\b(?:env|environment)\s*\.\s*(?:getProperty|getRequiredProperty)\s*\(\s*\"([^\"\s]+)\""),
    Rule("java_import", "java", r"(?m)^[ \t]*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", "java:", "code_file", "imports"),
    Rule("java_type", "java", r"(?m)^[ \t]*(?:(?:public|protected|private|abstract|final|static|sealed)\s+)*(?:class|interface|enum|record)\s+(\w+)", "entity:{path}:", "code_entity", "contains", scope="java-definition"),
    # Terraform
    Rule("tf_resource", "terraform", r"(?m)^[ \t]*resource[ \t]+\"([^\"]+\"[ \t]+\"[^\"]+)\"", "infra:", "infra_resource", "provisions"),
    Rule("tf_data", "terraform", r"(?m)^[ \t]*data[ \t]+\"([^\"]+\"[ \t]+\"[^\"]+)\"", "infra:data.", "data_asset", "reads"),
    Rule("tf_output", "terraform", r"(?m)^[ \t]*output[ \t]+\"([^\"]+)\"", "infra:output:", "config_key", "provides"),
    Rule("tf_variable", "terraform", r"(?m)^[ \t]*variable[ \t]+\"([^\"]+)\"", "infra:var:", "config_key", "contains"),
    Rule("tf_module", "terraform", r"(?m)^[ \t]*module[ \t]+\"([^\"]+)\"", "infra:module:", "infra_module", "contains"),
    # dbt
    Rule("dbt_ref", "dbt_sql", rf"\{{\{{[^{{}}]*?\bref\s*\(\s*(?:{Q}[^\"'`]*{Q}\s*,\s*)?{Q}({NQ}){Q}", "data:model:", "data_asset", "depends_on"),
    Rule("dbt_source", "dbt_sql", rf"\{{\{{[^{{}}]*?\bsource\s*\(\s*{Q}([^\"'`]+{Q}\s*,\s*{Q}[^\"'`]+){Q}", "data:source:", "data_asset", "reads"),
    Rule("dbt_env", "dbt_sql", rf"\benv_var\s*\(\s*{Q}({NQ}){Q}", "env:", "env_var", "reads"),
    Rule("dbt_var", "dbt_sql", rf"(?<![\w])var\s*\(\s*{Q}({NQ}){Q}", "config:dbt:", "config_key", "reads"),
    # PySpark: tables
    _table("spark_read_table", rf"\bspark\s*(?:\.read(?:Stream)?\s*)?\.\s*table\s*\(\s*{Q}({NQ}){Q}", "reads", 90),
    _table("spark_read_path", rf"{_READ}\.(?:parquet|csv|json|orc|text|avro|load|table)\s*\(\s*(?:path\s*=\s*)?{Q}({NQ}){Q}", "reads", 80),
    _table("spark_read_jdbc", rf"\bdbtable{Q}\s*,\s*{Q}({NQ}){Q}", "reads", 60),
    _table("spark_read_jdbc_call", rf"{_READ}\.jdbc\s*\(\s*(?:[^,()]|\([^()]*\))*,\s*(?:table\s*=\s*)?{Q}({NQ}){Q}", "reads", 60),
    _table("spark_write_jdbc", rf"{_WRITE}\.jdbc\s*\(\s*(?:[^,()]|\([^()]*\))*,\s*(?:table\s*=\s*)?{Q}({NQ}){Q}", "writes", 60),
    _table("spark_write_table", rf"\.(?:saveAsTable|insertInto|writeTo|toTable)\s*\(\s*{Q}({NQ}){Q}", "writes", 90),
    _table("spark_write_path", rf"{_WRITE}\.(?:parquet|csv|json|orc|text|avro|save|start)\s*\(\s*(?:path\s*=\s*)?{Q}({NQ}){Q}", "writes", 80),
    _table("sql_read", rf"(?i)\b(?:from|join|using)\s+{_SQL_NAME}(?=[\s\"'`,);]|$)(?!\s+import\b)", "reads", 40),
    _table("sql_write", rf"(?i)\b(?:insert\s+(?:into|overwrite)(?:\s+table)?|create\s+(?:or\s+replace\s+)?table(?:\s+if\s+not\s+exists)?|merge\s+into)\s+{_SQL_NAME}", "writes", 40),
    _table("delta_path", rf"\bDeltaTable\s*\.\s*(?:forPath|forName)\s*\(\s*\w+\s*,\s*{Q}({NQ}){Q}", "reads", 70, "data:delta:"),
    Rule("spark_conf", "python", rf"\.(?:config|set)\s*\(\s*{Q}(spark\.[\w.]+){Q}", "config:spark:", "config_key", "reads", scope="spark-conf"),
    Rule("spark_conf_get", "python", rf"\bconf\s*\.\s*get\s*\(\s*{Q}(spark\.[\w.]+){Q}", "config:spark:", "config_key", "reads", scope="spark-conf"),
]
#: Rules that look for tables run on files that use Spark only.
SPARK_FILE = r"\b(?:pyspark|SparkSession|spark\s*\.\s*(?:read|sql|table))"

"""Fixed tables of names: modules of languages, import names that differ from packages, families of models."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The built-in modules of Node.
NODE_MODULES = (
    "assert", "assert/strict", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "dns/promises", "domain", "events", "fs", "fs/promises",
    "http", "http2", "https", "inspector", "inspector/promises", "module", "net", "os", "path", "path/posix", "path/win32", "perf_hooks", "process", "punycode", "querystring", "readline", "readline/promises", "repl",
    "stream", "stream/consumers", "stream/promises", "stream/web", "string_decoder", "sys", "test", "timers", "timers/promises", "tls", "trace_events", "tty", "url", "util", "util/types", "v8", "vm", "wasi",
    "worker_threads", "zlib",
)
#: Node modules that are only known with their prefix.
NODE_PREFIXED = ("sqlite",)
#: Standard modules that newer Python versions have dropped.
DROPPED_MODULES = (
    "aifc", "asynchat", "asyncore", "audioop", "cgi", "cgitb", "chunk", "crypt", "distutils", "imghdr", "imp", "lib2to3", "mailcap", "msilib", "nis", "nntplib", "ossaudiodev", "pipes", "smtpd", "sndhdr", "spwd",
    "sunau", "telnetlib", "uu", "xdrlib",
)
#: Import names of Python with the packages that provide them.
IMPORT_ALIASES = {
    "yaml": ("pyyaml",), "PIL": ("pillow",), "cv2": ("opencv-python", "opencv-python-headless", "opencv-contrib-python"), "bs4": ("beautifulsoup4",), "dateutil": ("python-dateutil",), "sklearn": ("scikit-learn",),
    "dotenv": ("python-dotenv",), "jwt": ("pyjwt",), "OpenSSL": ("pyopenssl",), "Crypto": ("pycryptodome",), "attr": ("attrs",), "attrs": ("attrs",), "fitz": ("pymupdf",), "gi": ("pygobject",), "magic": ("python-magic",),
    "MySQLdb": ("mysqlclient",), "psycopg2": ("psycopg2", "psycopg2-binary"), "docx": ("python-docx",), "pptx": ("python-pptx",), "serial": ("pyserial",), "usb": ("pyusb",), "nacl": ("pynacl",), "zmq": ("pyzmq",),
    "cairo": ("pycairo",), "telegram": ("python-telegram-bot",), "Xlib": ("python-xlib",), "markdown_it": ("markdown-it-py",), "jose": ("python-jose",), "jenkins": ("python-jenkins",), "Levenshtein": ("python-levenshtein",),
}
#: Beginnings of model names, by which a family is known, and what a model's name is assigned to.
MODEL_FAMILIES = (
    "claude-opus-", "claude-sonnet-", "claude-haiku-", "claude-fable-", "claude-3", "gpt-", "o1-", "o1", "o3-", "o3", "o4-", "o4", "gemini-", "mistral-", "mixtral-", "llama-", "command-", "grok-", "deepseek-", "text-embedding-",
    "whisper-", "dall-e-", "tts-", "chatgpt-", "gemma-", "qwen-", "phi-", "nova-", "sonar-", "embed-", "rerank-", "anthropic.claude-", "us.anthropic.claude-", "eu.anthropic.claude-", "meta.llama", "amazon.nova-",
)
MODEL_SITES = ("model", "model_name", "modelId", "model_id")
#: Labels of ecosystems, as (name, default manifest).
ECOSYSTEMS = {"npm": "package.json", "pypi": "pyproject.toml"}


def standard_modules() -> frozenset[str]:
    """Top modules of Python's standard library: those of this interpreter and those dropped before it."""
    return frozenset(m for m in sys.stdlib_module_names if not m.startswith("_") or m in ("__future__", "_thread")) | frozenset(DROPPED_MODULES)


def builtins(spark: SparkSession) -> DataFrame:
    """(ecosystem, name) of built-in modules."""
    node = [("npm", m) for m in NODE_MODULES] + [("npm", f"node:{m}") for m in (*NODE_MODULES, *NODE_PREFIXED)]
    return spark.createDataFrame(node + [("pypi", m) for m in sorted(standard_modules())], "ecosystem string, name string")


def import_aliases(spark: SparkSession) -> DataFrame:
    """(ecosystem, name, package): packages that provide an import name, in their normal form."""
    return spark.createDataFrame([("pypi", n, p) for n, packages in IMPORT_ALIASES.items() for p in packages], "ecosystem string, name string, package string")


def known_family(value: Column, families: tuple[str, ...] = MODEL_FAMILIES) -> Column:
    """Whether a family's beginning starts the value; an empty family would accept everything, so it is refused."""
    if any(not f.strip() for f in families):
        raise ValueError("a family is empty")
    return F.exists(F.array(*map(F.lit, families)), lambda f: F.startswith(value, f))

"""Settings of a conversion and the command line's options."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from archloom import __version__
from archloom.functions.charset import parse_aliases


@dataclass(frozen=True)
class Config:
    inputs: list[str] = field(default_factory=list)
    name: str = ""
    url: str | None = None
    include_domains: list[str] = field(default_factory=list)
    favicon: str | None = None
    custom_css: str | None = None
    output: str = "."
    file_name: str | None = None
    title: str | None = None
    description: str | None = None
    long_description: str | None = None
    tags: str = ""
    lang: str | None = None
    publisher: str = "archloom"
    creator: str | None = None
    source: str | None = None
    progress_file: str | None = None
    scraper_suffix: str = ""
    continue_on_error: bool = False
    failed_items: str | None = None
    disable_metadata_checks: bool = False
    charsets_to_try: list[str] = field(default_factory=lambda: ["UTF-8", "ISO-8859-1"])
    ignore_content_header_charsets: bool = False
    content_header_bytes_length: int = 1024
    ignore_http_header_charsets: bool = False
    encoding_aliases: dict[str, str] = field(default_factory=dict)
    overwrite: bool = False
    verbose: bool = False

    def decoding(self) -> dict:
        return {"tries": tuple(self.charsets_to_try), "sniff_bytes": 0 if self.ignore_content_header_charsets else self.content_header_bytes_length, "ignore_http": self.ignore_http_header_charsets, "aliases": self.encoding_aliases}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="archloom", description="Web archives to tables of entries for offline reading")
    p.add_argument("-V", "--version", action="version", version=__version__)
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("inputs", nargs="*", help="archives, or folders of them")
    p.add_argument("-u", "--url", help="the main page; default: the first HTML page")
    p.add_argument("-i", "--include-domains", action="append", default=[], help="only entries whose host ends so; may be repeated")
    p.add_argument("-f", "--favicon", help="URL of the icon")
    p.add_argument("--custom-css", help="path of a style sheet for every page")
    p.add_argument("--name", required=True)
    p.add_argument("--output", default=".")
    p.add_argument("--file-name", help="default: {name}_{period}")
    for x in ("title", "description", "long-description", "creator", "source", "progress-file", "failed-items", "lang"):
        p.add_argument(f"--{x}")
    p.add_argument("--tags", default="", help="separated by semicolons")
    p.add_argument("--publisher", default="archloom")
    p.add_argument("--scraper-suffix", default="")
    p.add_argument("--continue-on-error", action="store_true")
    p.add_argument("--disable-metadata-checks", action="store_true")
    p.add_argument("--charsets-to-try", type=lambda x: [c.strip() for c in x.split(",")], default=["UTF-8", "ISO-8859-1"])
    p.add_argument("--ignore-content-header-charsets", action="store_true")
    p.add_argument("--content-header-bytes-length", type=int, default=1024)
    p.add_argument("--ignore-http-header-charsets", action="store_true")
    p.add_argument("--encoding-aliases", type=parse_aliases, default={})
    p.add_argument("--overwrite", action="store_true")
    return p


def from_args(args: list[str]) -> Config:
    return Config(**vars(parser().parse_args(args)))

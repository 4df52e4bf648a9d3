"""Archives made for the tests."""

from archloom.sources.warc import write_record

DATE = "2021-03-0{}T10:00:00Z"


def http(status=200, mime="text/html", body=b"", **more):
    head = [f"HTTP/1.1 {status} X"] + ([f"Content-Type: {mime}"] if mime else []) + [f"{k.replace('_', '-')}: {v}" for k, v in more.items()]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body


class Archive:
    def __init__(self, path, compress=True):
        self.path, self.compress, self.n = path, compress, 0
        open(path, "wb").close()

    def add(self, kind, url=None, block=b"", date=1, ctype="application/http", **headers):
        self.n += 1
        h = {"WARC-Record-ID": f"<urn:r:{self.n}>", "WARC-Date": DATE.format(date)}
        if url is not None:
            h["WARC-Target-URI"] = url
        h["Content-Type"] = f"{ctype}; msgtype={kind}" if ctype == "application/http" else ctype
        h |= {k.replace("_", "-"): v for k, v in headers.items()}
        with open(self.path, "ab") as f:
            f.write(write_record(kind, h, block, self.compress))
        return f"<urn:r:{self.n}>"

    def page(self, url, body, **more):
        return self.add("response", url, http(body=body if isinstance(body, bytes) else body.encode(), **more))

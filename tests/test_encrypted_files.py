"""Encrypted files: the ciphers by published vectors, and files that a writer of the tests locks."""

import hashlib
import zlib

import pytest

from foliospark.functions.page import page_inputs, process
from foliospark.sources import pdf_crypt as C
from foliospark.sources.pdf_syntax import PdfError
from foliospark.synth import PdfWriter

FONT = "<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding/FirstChar 0/Widths[" + "500 " * 256 + "]>>"
ID = bytes(range(16))


def test_ciphers():
    block, key = bytes.fromhex("00112233445566778899aabbccddeeff"), bytes(range(32))
    for n, told in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        assert C.aes_encrypt(key[:n], block, bytes(16)).hex() == told
        long = bytes(range(256)) * 3
        assert C.aes_decrypt(key[:n], C.aes_encrypt(key[:n], long, ID), ID) == long
    assert C.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"
    assert C.rc4(b"Wiki", b"pedia").hex().upper() == "1021BF0420"


def locked(method, revision, password=b""):
    """A file of one page that shows a line, locked by the handler."""
    fill = (password + C.PADDING)[:32]
    owner, extra = bytes(32), ""
    if revision <= 4:
        size = 5 if revision == 2 else 16
        key = hashlib.md5(fill + owner + (-4 & 0xFFFFFFFF).to_bytes(4, "little") + ID).digest()[:size]
        for _ in range(50 if revision >= 3 else 0):
            key = hashlib.md5(key).digest()[:size]
        user = C.rc4(key, C.PADDING)
        if revision >= 3:
            user = hashlib.md5(C.PADDING + ID).digest()
            for i in range(20):
                user = C.rc4(bytes(b ^ i for b in key), user)
            user += bytes(16)
    else:
        key = bytes(range(100, 132))
        user = C._hash(password, b"validate", revision) + b"validate" + b"keysalt."
        extra = f"/UE<{C.aes_encrypt(C._hash(password, b'keysalt.', revision), key, bytes(16)).hex()}>"

    def shut(data, number):
        if method == "AESV3":
            own = key
        else:
            own = hashlib.md5(key + number.to_bytes(3, "little") + bytes(2) + (b"sAlT" if method == "AESV2" else b"")).digest()[: min(len(key) + 5, 16)]
        if method == "V2":
            return C.rc4(own, data)
        pad = 16 - len(data) % 16
        return ID + C.aes_encrypt(own, data + bytes([pad]) * pad, ID)

    w = PdfWriter()
    catalog, tree, font, page = (w.reserve() for _ in range(4))
    body = shut(zlib.compress(b"BT /F1 12 Tf 10 100 Td (opened) Tj ET"), len(w.objects) + 1)
    content = w.add(b"<</Length %d/Filter/FlateDecode>>stream\n" % len(body) + body + b"\nendstream")
    w.set(font, FONT)
    w.set(page, f"<</Type/Page/Parent {tree} 0 R/MediaBox[0 0 200 200]/Contents {content} 0 R/Resources<</Font<</F1 {font} 0 R>>>>>>")
    w.set(tree, f"<</Type/Pages/Kids[{page} 0 R]/Count 1>>")
    w.set(catalog, f"<</Type/Catalog/Pages {tree} 0 R/Lang<{shut(b'en', catalog).hex()}>>>")
    version = {"AESV3": 5, "AESV2": 4}.get(method, 1 if revision == 2 else 2)
    filters = f"/CF<</StdCF<</CFM/{method}/Length 16>>>>/StmF/StdCF/StrF/StdCF" if version >= 4 else ""
    told = w.add(f"<</Filter/Standard/V {version}/R {revision}/Length {40 if revision == 2 else 128}/P -4/O<{owner.hex()}>/U<{user.hex()}>{extra}{filters}>>")
    return w.file(catalog, f"/Encrypt {told} 0 R/ID[<{ID.hex()}><{ID.hex()}>]")


@pytest.mark.parametrize(("method", "revision"), [("V2", 2), ("V2", 3), ("AESV2", 4), ("AESV3", 5), ("AESV3", 6)])
def test_files_without_a_password_open(method, revision):
    data = locked(method, revision)
    for file in (data, data.replace(b"startxref", b"startxxxx")):
        (page,) = page_inputs(file)
        assert [x.text for x in process(page).lines] == ["opened"]
    with pytest.raises(PdfError, match="password"):
        list(page_inputs(locked(method, revision, b"secret")))

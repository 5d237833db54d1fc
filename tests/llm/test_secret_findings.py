import base64
import random
import string

import pytest

from logtide.llm import secret_scans as S

BASE64 = string.ascii_letters + string.digits + "+/"
PROSE = "The service reads its settings once at start and writes what it did into a log. " * 3


def found(text):
    return [text[a:b] for _, a, b in S.novel_spans(text, S.base_spans(text), S.Novelty())]


def drawn(rng, alphabet, n):
    """Random, with a letter at either end so that nothing is stripped."""
    return rng.choice("ABCDEF") + "".join(rng.choices(alphabet, k=n - 2)) + rng.choice("ABCDEF")


def jwt(rng, size):
    part = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    claims = f'{{"sub":"{rng.randrange(10**10)}","iat":{rng.randrange(10**10)},"jti":"{rng.getrandbits(128):032x}"}}'
    return ".".join([part(b'{"alg":"HS256","typ":"JWT"}'), part(claims.encode()), part(rng.randbytes(size))])


@pytest.mark.parametrize("n", [16, 24, 40, 64, 128, 259, 400, 512, 1000, 2000])
def test_random_keys_of_any_length_and_alphabet(n):
    rng = random.Random(n)
    for alphabet in (BASE64, "0123456789ABCDEF"):
        keys = [drawn(rng, alphabet, n) for _ in range(20)]
        hits = sum(found(f"{PROSE} signature: {k} {PROSE}") == [k] for k in keys)
        assert hits >= 19, (alphabet, hits)


def test_jwts():
    rng = random.Random(5)
    for size in (32, 64, 256, 512):
        keys = [jwt(rng, size) for _ in range(20)]
        assert sum(found(f"{PROSE} Authorization: Bearer {k} {PROSE}") == [k] for k in keys) >= 19


def test_keys_that_stand_twice():
    rng = random.Random(9)
    for n in (20, 40, 200, 600):
        key = drawn(rng, string.ascii_letters + string.digits, n)
        line = f"auth: {key}, retries 3\n"
        assert found(line * 2) == [key] * 2 and found(line * 5) == [key] * 5
        assert found(f"dev signature {key} and {PROSE} prod signature {key}") == [key] * 2
        assert found(f"bearer {key}\necho {key}") == [key]
        assert found(f"bearer {key}\nauth: /v/{key}") == [key, f"/v/{key}"]
        for gap in range(max(1, S.SURROUNDINGS - n), S.SURROUNDINGS, n // 4):  # copies across the edge
            assert found(f"bearer {key} {('lorem ' * 200)[:gap]} {key}") == [key]


def test_repeated_keys_are_masked(spark, docs_of):
    key = "Zk3jd8Qm2LxP9vT7aWq1"
    rows = S.redact(docs_of([(1, f"auth: {key}\n" * 3)])).collect()
    assert rows[0].text == "auth: [SECRET]\n" * 3


def test_letters_only_and_digits_at_one_end():
    assert found("bearer qWzXbHkLmPoRtYvNcJdS") == ["qWzXbHkLmPoRtYvNcJdS"]
    assert found("bearer qWzXbHkLmPoRtYvNcJdS7") == ["qWzXbHkLmPoRtYvNcJdS7"]
    rng = random.Random(4)
    for n in (20, 32, 64, 300):
        keys = ["".join(rng.choices(string.ascii_letters, k=n)) for _ in range(40)]
        hits = sum(found(f"{PROSE} bearer {k} {PROSE}") == [k] for k in keys)
        assert hits >= 36, (n, hits)


def test_words_and_paths_are_no_keys():
    for name in ("internationalization", "Donaudampfschifffahrt", "Jean-Baptiste-Emmanuel", "jonathan-kowalski",
                 "getUserSessionTokenFromCache", "straightforwardness", "Wahrscheinlichkeitsrechnung",
                 "MessageAuthenticationProvider", "/usr/local/share/zoneinfo", "password_reset_for_admins",
                 "www.smithsonianmag.com/history", "/2019/03/12/how-to-bake-sourdough-bread"):
        assert found(f"author {name} {PROSE}") == found(f"{PROSE} auth: {name}") == [], name


def test_every_run_within_reach_is_measured():
    key = "Zk3jd8Qm2LxP9vT7aWq1"
    assert found(f"password_reset_for_admins = {key}") == [key]
    assert found(f"password_reset_for_admins={key}") == [key]
    assert found(f"password_reset_for_all_admins_and_guests_of_house = {key}") == [key]
    assert found(f"auth: configuration_default {key}") == [key]
    assert found(f"auth: {key} Yq7nB2kfR9sD4wXt0LmZ") == [key, "Yq7nB2kfR9sD4wXt0LmZ"]
    assert found("auth" * 20_000 + f" {key}") == [key]

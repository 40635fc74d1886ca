"""Services under load and failure, ready services, and what a failed run leaves."""

import time
import urllib.error

import pandas as pd
import pytest
from pyspark.sql import functions as F

from oakmill.operators import presets
from oakmill.operators.services import ANY, FunctionService, HTTPService, Service
from oakmill.session import Engine


def frame(*values):
    return pd.DataFrame({0: list(values)})


class Slow(Service):
    async def infer_one(self, row):
        import asyncio

        await asyncio.sleep(0.1)
        return frame(row.iloc[0] * 2)


class SlowPlain(Service):
    def infer_one(self, row):
        time.sleep(0.1)
        return frame(row.iloc[0] * 2)


@pytest.mark.parametrize("kind", [Slow, SlowPlain])
def test_rows_are_under_way_together(kind):
    began = time.time()
    out = kind("slow", concurrency=20).infer_batch(frame(*range(20)))
    assert [x.iloc[0, 0] for x in out] == [2 * k for k in range(20)] and time.time() - began < 1


def test_functions_may_be_coroutines():
    async def double(rows):
        return rows * 2

    assert FunctionService("d", double).infer_flat(frame(1, 2))[0][0].tolist() == [2, 4]


def refusing(times, code):
    left = [times]

    def transport(url, headers, body):
        if left[0]:
            left[0] -= 1
            raise urllib.error.HTTPError(url, code, "no", {"Retry-After": "0"}, None)
        return {"out": body["x"]}

    return transport


def test_retries():
    service = lambda times, code, **more: HTTPService("s", "http://s", [("x",)], [("out",)], transport=refusing(times, code), backoff=0.01, **more)
    assert service(2, 503).infer_one(pd.Series([7])).iloc[0, 0] == 7
    with pytest.raises(urllib.error.HTTPError):
        service(2, 429, retries=1).infer_one(pd.Series([7]))
    with pytest.raises(urllib.error.HTTPError):
        service(1, 404).infer_one(pd.Series([7]))  # no use trying again


def test_a_limit_is_shared_by_all_tasks():
    whole = HTTPService("s", "http://s", [("x",)], [("out",)], transport=refusing(0, 0), per_minute=1200)
    own = whole.for_tasks(4)
    began = time.monotonic()
    own.infer_batch(frame(1, 2, 3))
    assert time.monotonic() - began >= 2 * 4 * 60 / 1200 and whole._tasks == 1


def engine(spark, service):
    e = Engine(spark)
    e.register_blob_table("numbers", spark.range(40).withColumnRenamed("id", "n"), ["n"])
    e.register_output_table("doubles", "n long, d long", ["n"], {"n": "numbers.n"})
    e.register_inference_service(service)
    e.bind_inference_service(service.name, (["numbers.n"], ["doubles.d"]), {"numbers.n": "doubles.n"})
    return e


def test_calls_are_counted(spark):
    e = engine(spark, FunctionService("doubler", lambda rows: rows * 2, preferred_batch_size=1000))
    assert e.execute("SELECT SUM(d) AS s FROM doubles").first()["s"] == 2 * sum(range(40))
    assert e.rows_sent == {"doubler": 40} and e.calls == {"doubler": 1}


def test_a_failed_run_adds_nothing(spark, monkeypatch):
    e = engine(spark, FunctionService("doubler", lambda rows: rows * 2))
    write = e.inference.store.add

    def broken(service, **parts):
        parts["seen"] = parts["seen"].withColumn("n", F.raise_error(F.lit("lost")))
        write(service, **parts)

    monkeypatch.setattr(e.inference.store, "add", broken)
    with pytest.raises(Exception, match="lost"):
        e.execute("SELECT SUM(d) AS s FROM doubles")
    monkeypatch.setattr(e.inference.store, "add", write)
    assert e.execute("SELECT COUNT(*) AS n FROM doubles").first()["n"] == 40  # once each, as nothing of the first run is left


def test_views_of_the_user_stay(spark):
    spark.range(3).createOrReplaceTempView("doubles")
    e = engine(spark, FunctionService("doubler", lambda rows: rows * 2))
    assert e.execute("SELECT COUNT(*) AS n FROM doubles").first()["n"] == 40
    assert spark.table("doubles").count() == 3 and not spark.catalog.tableExists("numbers")
    spark.catalog.dropTempView("doubles")


def test_scratch_can_be_cleared(spark):
    from oakmill.operators.inference import folder_exists

    e = engine(spark, FunctionService("doubler", lambda rows: rows * 2))
    e.execute("SELECT SUM(d) AS s FROM doubles").collect()
    assert folder_exists(spark, f"{e.inference.store.folder}/scratch")
    e.clear_scratch()
    assert not folder_exists(spark, f"{e.inference.store.folder}/scratch")
    assert e.execute("SELECT COUNT(*) AS n FROM doubles").first()["n"] == 40 and e.rows_sent == {"doubler": 40}


def test_ready_services():
    asked = []

    def answer(given):
        def transport(url, headers, body):
            asked.append((url, headers, body))
            return given

        return transport

    chat = presets.openai_chat("c", "key", "m", prompt=("Say: ", "!"), transport=answer({"choices": [{"message": {"content": "hi"}}, {"message": {"content": "ho"}}]}))
    assert chat.infer_one(pd.Series(["hello"]))[0].tolist() == ["hi", "ho"]
    assert asked[-1][1] == {"Authorization": "Bearer key"} and asked[-1][2] == {"model": "m", "messages": [{"role": "user", "content": "Say: hello!"}]}
    images = presets.openai_images("i", "key", transport=answer({"data": [{"url": "u1"}, {"url": "u2"}]}))
    assert images.infer_one(pd.Series(["a cat"]))[0].tolist() == ["u1", "u2"]
    classes = presets.huggingface_text("h", "key", "some/model", [(0, ANY, "label"), (0, ANY, "score")], transport=answer([[{"label": "A", "score": 0.9}, {"label": "B", "score": 0.1}]]))
    assert classes.infer_one(pd.Series(["text"])).values.tolist() == [["A", 0.9], ["B", 0.1]] and asked[-1][0].endswith("/some/model")
    sound = presets.huggingface_file("f", "key", "m", [(ANY, "label")], transport=answer([{"label": "dog"}]))
    assert sound.infer_one(pd.Series(["/x.wav"]))[0].tolist() == ["dog"] and asked[-1][2] == {"file": "/x.wav"}
    vision = presets.google_vision("g", "key", "SAFE_SEARCH_DETECTION", [("safeSearchAnnotation", "adult")], transport=answer({"responses": [{"safeSearchAnnotation": {"adult": "UNLIKELY"}}]}))
    assert vision.infer_one(pd.Series(["http://p"]))[0].tolist() == ["UNLIKELY"]
    assert asked[-1][2] == {"requests": [{"features": [{"type": "SAFE_SEARCH_DETECTION"}], "image": {"source": {"imageUri": "http://p"}}}]}
    audio = presets.openai_audio("a", "key", transport=answer({"text": "spoken"}))
    assert audio.infer_one(pd.Series(["/x.mp3"]))[0].tolist() == ["spoken"] and asked[-1][2] == {"model": "whisper-1", "file": "/x.mp3"}


def test_forms_hold_files(tmp_path):
    (tmp_path / "a.wav").write_bytes(b"\x00\x01")
    data, kind = presets.form({"model": "m", "file": str(tmp_path / "a.wav")})
    assert b'name="model"\r\n\r\nm\r\n' in data and b'filename="a.wav"\r\n\r\n\x00\x01\r\n' in data and kind.startswith("multipart/form-data; boundary=")


def test_models_are_loaded_once():
    loads = []
    service = presets.ModelService("m", lambda: loads.append(1) or 10, lambda model, rows: rows + model)
    for _ in range(3):
        assert service.infer_flat(frame(1, 2))[0][0].tolist() == [11, 12]
    assert loads == [1]

from tidemark.functions import media
from tidemark.functions.responses import chosen_ids, decision, first_json, section


def say(spark, expression):
    return spark.sql(f"SELECT {expression}").first()[0]


def test_frames_and_times(spark):
    assert say(spark, media.frame_indices("100L", "20", 1, 64)) == [0, 20, 40, 60, 80]
    assert say(spark, media.frame_indices("200L", "1", 1, 3)) == [0, 99, 199] and say(spark, media.frame_indices("0L", "20", 1, 64)) == []
    assert say(spark, media.srt_time("3723.5")) == "01:02:03,500"
    assert say(spark, media.probe_duration("'x Duration: 01:02:03.50, start'")) == 3723.5 and say(spark, media.probe_duration("'none'")) is None
    assert [say(spark, x) for x in media.smart_resize("100", "200")] == [112, 196]


def test_first_json():
    assert first_json('```json\n{"a": [1, "}"]} rest```') == '{"a": [1, "}"]}'
    assert first_json("<think>{no}</think> [1, 2]") == "[1, 2]"
    assert first_json('{"a": ["x", "y') == '{"a": ["x", "y"]}'
    assert first_json('{"a": ["x"], "b": [["p", "q"') == '{"a": ["x"], "b": [["p", "q"]]}'
    assert first_json("nothing") is None and first_json(None) is None


def test_responses(spark):
    assert say(spark, section("'[[ ## k ## ]] one [[ ## m ## ]] two'", "k")) == "one"
    assert say(spark, chosen_ids("'I take [\"b\", \"z\"]'", "array('a', 'b')")) == ["b"] and say(spark, chosen_ids("'only a fits'", "array('a1', 'a')")) == ["a"]
    got = say(spark, decision("'so {\"decision\": \"search\", \"content\": \"kettle\"}'"))
    assert (got["decision"], got["content"]) == ("search", "kettle")
    assert say(spark, decision("'plain'"))["decision"] == "answer"

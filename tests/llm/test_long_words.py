from wavemark.llm import quality


def test_shape_of_a_long_word_is_taken_from_all_of_it():
    shapes = quality._Shapes()
    head = "aB1" * 100
    assert shapes[head + "x,y;" * 50] != shapes[head + "-9-" * 50]
    assert shapes["a" * 500] == shapes["a"] and shapes["a" * 500 + "1"] == shapes["a1"]

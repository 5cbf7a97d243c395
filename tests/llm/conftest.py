import pytest


@pytest.fixture(scope="session")
def html_model():
    from quillspark.llm import html_blocks

    return html_blocks.train()

from skeinflow.operators import build, facts

FILES = {
    "app/main.py": """from fastapi import FastAPI
from app.runner import Planner
app = FastAPI()
@app.post("/ask")
def ask(q):
    Planner().run(q)
    return store(q)
def store(q):
    session.add(q)
""",
    "app/runner.py": """import openai
class Planner:
    def run(self, q):
        check_text(q)
        return openai.chat.completions.create(q)
class Helper:
    def nothing(self):
        return 1
""",
    "mcp/servers/mail/tools.py": """def send(to):
    return to
def _hidden():
    pass
def drop(path):
    os.remove(path)
""",
    "srv.py": """from mcp.server.fastmcp import FastMCP
mcp = FastMCP("files")
@mcp.tool()
def read_file(p):
    return open(p).read()
""",
    "chain.py": """from langchain.agents import AgentExecutor
from langchain_openai import ChatOpenAI
from langchain.tools import tool
llm = ChatOpenAI(model="x")
@tool
def look(q):
    return q
agent = AgentExecutor(tools=[look], llm=llm)
""",
    "nolib.py": "agent = AgentExecutor(tools=[])\n",
    "bad.py": "def (",
}


def found(spark):
    return facts.facts(spark.createDataFrame([(p, "python", bytearray(t.encode())) for p, t in FILES.items()], "path string, language string, content binary")).coalesce(1).cache()


def test_nodes_and_edges(spark):
    nodes, edges = build.build(found(spark))
    by_id = {r.id: r for r in nodes.collect()}
    kinds = {(r.kind, r.name, r.file) for r in by_id.values() if r.kind not in ("store", "untrusted_source")}
    assert kinds == {
        ("entry_point", "POST /ask", "app/main.py"), ("sink", "store", "app/main.py"), ("agent", "Planner", "app/runner.py"),
        ("mcp_server", "mail", "mcp/servers/mail/tools.py"), ("tool", "send", "mcp/servers/mail/tools.py"), ("sink", "drop", "mcp/servers/mail/tools.py"),
        ("mcp_server", "files", "srv.py"), ("tool", "read_file", "srv.py"), ("entry_point", "MCP:files", "srv.py"),
        ("agent", "AgentExecutor", "chain.py"), ("llm_endpoint", "ChatOpenAI", "chain.py"), ("tool", "look", "chain.py"),
    }
    named = {(by_id[r.source_id]["name"], r.kind, by_id[r.target_id]["name"]) for r in edges.collect()}
    assert named == {
        ("POST /ask", "has_access_to", "store"), ("POST /ask", "delegates_to", "Planner"), ("mail", "provides_tool", "send"), ("send", "has_access_to", "drop"),
        ("MCP:files", "delegates_to", "read_file"), ("AgentExecutor", "uses_tool", "look"), ("AgentExecutor", "uses_model", "ChatOpenAI"),
    }


def test_empty_sources_give_nothing(spark):
    nodes, edges = build.build(found(spark).limit(0))
    assert nodes.count() == 0 and edges.count() == 0

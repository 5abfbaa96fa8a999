"""A small planted source tree that shows every kind of fact, so that what is read from sources can be checked row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "app/web.py": '''import os
from fastapi import FastAPI, UploadFile, File, Form
from app.agents import Planner, start
from app.helper import Assistant, boot
app = FastAPI()
@app.post("/upload")
def upload(doc: UploadFile, note: str = Form()):
    keep(doc)
    return Planner(doc)
def keep(doc):
    open("data/uploads/" + doc.name, "wb").write(doc)
@app.get("/ask/{q}")
def ask(q):
    start(q)
@bp.route("/flask", methods=["put", "post"])
def flask_view():
    f = request.files["doc"]
    with open("data/flask.bin", mode="w") as out:
        out.write(f)
@require_POST
def django_view(request):
    request.FILES.get("doc")
    os.remove("data/old")
@api_view(["get"])
def listed(request):
    return boot(request)
@app.websocket("/ws")
def ws(c):
    Assistant(c)
@app.get(PATH)
def no_literal():
    pass
''',
    "app/agents.py": '''import openai
import subprocess
from .tools import search
class Base:
    def shell(self, cmd):
        subprocess.run(cmd, shell=True)
class Planner(Base):
    limit = os.getenv("API_KEY")
    def run(self, q):
        check_text(q)
        def inner(x):
            return collection.query(x)
        return openai.chat.completions.create(inner(q))
    def plan(self, q):
        return openai.chat.completions.create(check_text(q))
class Quiet:
    def run(self, q):
        return q
def start(q):
    return Planner(q)
def check_text(q):
    return q.strip()
def listing():
    server = create_mcp_server("mail")
    return client.list_tools(open("data/tools.json").read())
requests.post(URL)
''',
    "app/tools.py": '''def search(q, limit=5):
    cursor.execute("SELECT * FROM notes WHERE x = 1")
    return save(q)
def save(row):
    cursor.execute(f"INSERT INTO notes VALUES ({row})")
    session.commit()
def save_fixed():
    session.add("row")
def catalogue(path):
    open("data/tools.json", "w").write(path)
''',
    "app/helper.py": '''import openai
class Assistant:
    def answer(self, q):
        return openai.chat.completions.create(q)
class Explorer:
    def tools(self):
        openai.chat.completions.create(client.list_tools())
        return create_mcp_server("mail")
def boot(q):
    return Assistant(q)
''',
    "app/page.py": '''import streamlit as st
from app.tools import save
def on_send(x):
    save(x)
    open("data/page.txt", "a").write(x)
if st.button("send"):
    on_send(st.file_uploader("doc"))
st.button("again")
''',
    "app/readers.py": '''from app.web import flask_view
class Viewer:
    def render(self):
        return open("data/flask.bin").read()
    def refresh(self):
        return open(self.path)
def spawn(path):
    return subprocess.run(open("data/flask.bin").read())
def stash(x):
    open(x.path, "w").write(x)
''',
    "run.py": '''from app.tools import catalogue
FACTORY = "app.mcp.servers.mail.server.create_mail_server"
if __name__ == "__main__":
    catalogue("x")
''',
    "app/mcp/servers/mail/server.py": '''from app.tools import save
def send_mail(to):
    save(to)
    smtp.sendmail(to)
def fetch_mail():
    return imap.fetch(1)
def _hidden(): pass
''',
    "chain.py": '''from langchain.agents import AgentExecutor, create_react_agent
from langchain_openai import ChatOpenAI
from langchain.tools import tool, Tool
from langchain_core.callbacks import BaseCallbackHandler
from shared_tools import shared
llm = ChatOpenAI(model="x")
calc = Tool(name="calc", func=f)
wrapped = StructuredTool.from_function(helper)
@tool
def look(q):
    return requests.get(q)
agent = AgentExecutor(tools=[calc], llm=llm)
other = create_react_agent(model=ChatOpenAI(), tools=load())
class Audit(BaseCallbackHandler, Other):
    pass
''',
    "shared_tools.py": '''from langchain.tools import tool
@tool
def shared():
    return os.environ.get("HOME")
''',
    "graph.py": '''from langgraph.graph import StateGraph
g = StateGraph(S)
g.add_node("plan", f)
g.add_node("search_tools", f)
g.add_edge("plan", "search_tools")
g.add_conditional_edges("search_tools", route, {"a": "plan", "b": "write"})
g.set_entry_point("plan")
''',
    "srv.py": '''from mcp.server.fastmcp import FastMCP
from fastmcp.server.middleware import Middleware
mcp = FastMCP("files", name="file-server")
class Gate(Middleware):
    pass
mcp.add_middleware(Gate())
@mcp.tool()
def read_file(p):
    return open(p).read()
''',
    "low.py": '''from mcp.server import Server
class Host:
    def __init__(self):
        self.app = Server("low-level")
low = Server(name="low")
@low.call_tool()
def call(name):
    return name
''',
    "guards.py": '''import guardrails as gd
from nemoguardrails import LLMRails
shield = gd.Guard.from_string("x")
LLMRails(config)
rails = LLMRails(config)
''',
    "objects.py": '''import boto3, s3fs
from minio import Minio
s3 = boto3.client("s3")
def up(key):
    s3.put_object(Bucket="raw", Key="in/" + key)
    s3.upload_file(key, "raw", "in/fixed")
def down(key):
    fs = s3fs.S3FileSystem()
    fs.open("s3://raw/in/x", "rb")
    mc = Minio("host")
    mc.get_object("cold", "a")
    s3.download_file("raw", key, "local")
    Path("data/flask.bin").read_text()
    db.executemany("DELETE FROM notes", rows)
    db.executemany("SELECT 1", rows)
''',
    "broken.py": "def (",
}


def planted(spark: SparkSession) -> DataFrame:
    """(path, language, content) of the tree."""
    return spark.createDataFrame([(path, "python", bytearray(text.encode())) for path, text in FILES.items()], "path string, language string, content binary")

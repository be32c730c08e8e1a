"""FastAPI routes over several files: imports, aliases, mounts and what stays unknown."""

from factloom.sources.python_routes import fastapi_routes

FILES = {
    "app/main.py": '''
from fastapi import FastAPI
from .routers import items, users as people
from app.routers.admin import router as admin_router
from app import passed
import app.routers.health as health
import other

app = FastAPI(title="x (y)", tags=["a", "b"])  # app.include_router(no)
app.include_router(items.router, prefix="/v1")
app.include_router(people.router)
app.include_router(router=admin_router, prefix='/adm,in/')
app.include_router(passed)
app.include_router(health.router, prefix=PREFIX)
app.include_router(other.router)
app.include_router(make())

@app.get("/root(1)")
async def root(): return """
@app.get("/docstring")
"""
''',
    "app/__init__.py": "from .routers.passing import router as passed\n",
    "app/routers/__init__.py": "",
    "app/routers/items.py": "from fastapi import APIRouter\nrouter: APIRouter = APIRouter(\n    prefix='/items',\n)\n\n@router.get(\"/\")\n@cached(1, (2))\ndef list_items(a=Depends(x)): pass\n\n@router.post(path='/{id}')\ndef add(): pass\n@router.put(f'/{x}')\ndef put(): pass\n@elsewhere.get('/e')\ndef e(): pass\n",
    "app/routers/users.py": "import fastapi\nrouter = fastapi.APIRouter()\nnested = fastapi.APIRouter(prefix='/n')\n@nested.get('/before')\ndef before(): pass\nrouter.include_router(nested, prefix='/in')\n@nested.get('/after')\ndef after(): pass\n@router.delete('/u')\ndef drop(): pass\n",
    "app/routers/admin.py": "from fastapi import APIRouter\nrouter = APIRouter()\nrouter = APIRouter(prefix='/twice')\n@router.get('/x')\ndef x(): pass\n",
    "app/routers/passing.py": "from fastapi import APIRouter\nrouter = APIRouter(prefix='/p')\nrouter.include_router(router)\n@router.get('q')\ndef q(): pass\n",
    "app/routers/health.py": "from fastapi import APIRouter\nrouter = APIRouter(prefix=BASE)\n@router.get('/h')\ndef h(): pass\n",
    "app/notes.md": "@app.get('/no')",
}


def test_routes_are_composed_over_files(spark):
    rows = [(r, p, t) for r in ("one", "two") for p, t in FILES.items()] + [("one", "empty.py", None), ("one", "app/main.py", FILES["app/main.py"])]
    endpoints, unknowns = fastapi_routes(spark.createDataFrame(rows, "repo string, path string, text string"), "repo", "path", "text")
    got = endpoints.collect()
    assert sorted(tuple(r)[1:] for r in got if r["repo"] == "one") == sorted(tuple(r)[1:] for r in got if r["repo"] == "two") == sorted([
        ("app.main#app", "app.main#app", "GET", "/root(1)", "root"), ("app.main#app", "app.routers.items#router", "GET", "/v1/items", "list_items"),
        ("app.main#app", "app.routers.items#router", "POST", "/v1/items/{id}", "add"), ("app.main#app", "app.routers.users#router", "DELETE", "/u", "drop"),
        ("app.main#app", "app.routers.users#nested", "GET", "/in/n/before", "before"), ("app.main#app", "app.routers.passing#router", "GET", "/p/q", "q")])
    reasons = sorted((r["module"], r["reason"]) for r in unknowns.collect() if r["repo"] == "one")
    assert reasons == sorted([
        ("app.routers.items", "route-path-not-literal"), ("app.routers.items", "router-variable-not-locally-declared"), ("app.routers.admin", "router-ambiguous"), ("app.routers.health", "router-prefix-not-literal"),
        ("app.main", "mount-prefix-not-literal"), ("app.main", "mount-child-not-resolved"), ("app.main", "mount-child-not-resolved"), ("app.routers.passing", "mount-cycle")])

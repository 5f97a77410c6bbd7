"""logweave: log analytics on Spark DataFrames.

Most-used entry points; everything else lives in ``sources``, ``functions``,
``operators``, ``plans`` and ``streaming``.
"""

from .plans.profile import LogProfile
from .plans.rules import Match, Paint, SavedView, SearchQuery, ViewFilter
from .plans.workspace import WorkspaceView, open_workspace
from .session import build_session
from .sources.files import read_workspace, scan_workspace
from .sources.lines import read_lines, write_numbered

__all__ = [
    "LogProfile", "Match", "Paint", "SavedView", "SearchQuery", "ViewFilter",
    "WorkspaceView", "build_session", "open_workspace", "read_lines", "read_workspace", "scan_workspace",
    "write_numbered",
]

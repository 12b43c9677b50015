"""The derived fixtures of FIXTURES.md §2 as DuckDB SQL (CTE bodies)."""

from __future__ import annotations

RICH_PAGES = r"""
SELECT doc_id AS page_id,
  CASE WHEN doc_id % 2 = 0 THEN 'https://d' || doc_id || '.example.com/'
       ELSE 'http://d' || doc_id || '.example.com/home' END AS url,
  CAST(CASE WHEN doc_id % 17 = 0 THEN 404 WHEN doc_id % 29 = 0 THEN 500 ELSE 200 END AS INTEGER) AS status_code,
  '<!DOCTYPE html><html><head><meta charset="utf-8"><title>'
  || (CASE WHEN doc_id % 6 = 0 THEN '# ' ELSE '' END) || substring(clean, 1, CAST(doc_id % 90 AS INTEGER)) || '</title>'
  || CASE WHEN doc_id % 200 > 0 AND doc_id % 2 = 0
          THEN '<meta name="description" content="' || substring(clean, 1, CAST(doc_id % 200 AS INTEGER)) || '">'
          WHEN doc_id % 200 > 0
          THEN '<meta content="' || substring(clean, 1, CAST(doc_id % 200 AS INTEGER)) || '" name="description">'
          ELSE '' END
  || CASE WHEN doc_id % 3 = 0 THEN '<meta property="og:title" content="' || substring(clean, 1, 40) || '">' ELSE '' END
  || CASE WHEN doc_id % 4 = 0 THEN '<meta property="og:image" content="/img/' || doc_id || '.png">' ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN '<meta name="icon" content="/favicon.ico">' ELSE '' END
  || '</head><body><nav><a href="/">Home</a><a href="/about">About</a>'
  || '<a href="team/../contact?x=1">Team</a><a href="/p#frag">Skip</a>'
  || '<a href="mailto:info@d' || doc_id || '.example.com">Mail</a>'
  || CASE WHEN doc_id % 2 = 0 THEN '<a href="https://www.linkedin.com/company/d' || doc_id || '">in</a>' ELSE '' END
  || CASE WHEN doc_id % 3 = 1 THEN '<a href="https://netflix.com/title/' || doc_id || '">tv</a>' ELSE '' END
  || '<a href="//partner' || (doc_id % 7) || '.example.org/x/./y/../z">P</a>'
  || '<a href="HTTP://WWW.D' || doc_id || '.EXAMPLE.COM:80/Caps">C</a>'
  || '</nav><main><p>' || text || '</p></main></body></html>' AS html
FROM (SELECT doc_id, text, regexp_replace(text, '["''<>]', '', 'g') AS clean FROM documents)
"""

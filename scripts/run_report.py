"""spark-submit entry point for the report job (see logtide/plans/report.py).

    spark-submit --py-files logtide.zip scripts/run_report.py --input logs/ --out /shared/out/run1
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logtide.plans.report import main  # noqa: E402

if __name__ == "__main__":
    main()
